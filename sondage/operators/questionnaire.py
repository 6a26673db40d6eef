"""Questionnaire columns: field types, multiple answers, JSON ranges, free text, ordinal scales, response rates, consistency."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.operators.correlation import correlations
from sondage.operators.types import clean, is_number, need, numeric_columns, scalar_columns

# Vocabularies and patterns of questionnaires.
SEPARATOR = "|"
MULTI_SHARE, JSON_SHARE, ORDINAL_MOST, FREE_TEXT_WORDS = 0.10, 0.30, 8, 4
SCALES = [
    ["tout a fait d'accord", "d'accord", "neutre", "pas d'accord", "pas du tout d'accord"],
    ["tres satisfait", "satisfait", "neutre", "insatisfait", "tres insatisfait"],
    ["jamais", "rarement", "parfois", "souvent", "toujours"],
    ["never", "rarely", "sometimes", "often", "always"],
    ["pas important", "peu important", "assez important", "important", "tres important"],
    ["strongly disagree", "disagree", "neutral", "agree", "strongly agree"],
]
BINARY = [["oui", "non"], ["yes", "no"], ["vrai", "faux"], ["true", "false"], ["0", "1"], ["1", "2"]]
FILTER_NAME = r"si.oui|si.non|precis|detail|autre|other|si.vous|if.yes|if.no|veuillez.precis|please.specify"
TIME_NAME = r"heure|horaire|time|depart|arrivee|arrival"
TEXT_NAME = r"commentaire|comment|note|texte|text|description|observation|remarque|precis|autre|other|feedback|suggestion|motif|raison|detail|expliqu|libre"
REFUSAL = r"^(rien|aucun|aucune|neant|n/a|na|non|aucun commentaire|pas de commentaire|sans|nothing|none|no comment|no|/|\.)$"
ALIASES = {"min": ["min", "minimum", "debut", "start", "from", "de"], "max": ["max", "maximum", "fin", "end", "to", "a"], "mid": ["mid", "middle", "milieu", "median", "med", "moyen"]}

_NULL_TEXT = ["nan", "None", ""]


def answer(column: str) -> Column:
    """The trimmed text of a cell; null for null texts."""
    text = F.trim(F.col(column).cast("string"))
    return F.when(~text.isin(_NULL_TEXT), text)


def is_filter(name: str) -> bool:
    return bool(re.search(FILTER_NAME, name, re.IGNORECASE))


def field_types(df: DataFrame) -> dict[str, str]:
    """The type of each column. One aggregation over all columns; of the values, only sets of up to nine are gathered."""
    df = clean(df)
    kinds = {f.name: f.dataType for f in df.schema}
    names = scalar_columns(df)
    few = ORDINAL_MOST + 1
    exprs = []
    for i, c in enumerate(names):
        text = answer(c)
        has_range = F.arrays_overlap(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")), F.array(F.lit("min"), F.lit("max"), F.lit("mid")))
        exprs += [
            F.count(text).alias(f"n{i}"),
            F.avg(F.contains(text, F.lit(SEPARATOR)).cast("int")).alias(f"multi{i}"),
            F.avg(has_range.cast("int")).alias(f"json{i}"),
            F.avg(F.when(text.isNotNull(), F.size(F.split(text, r"\s+")))).alias(f"words{i}"),
            F.approx_count_distinct(F.lower(text)).alias(f"d{i}"),
            F.min(F.lower(text)).alias(f"lo{i}"),
        ]
    one = df.agg(*exprs).first().asDict()
    small = [i for i in range(len(names)) if one[f"n{i}"] and one[f"d{i}"] <= 2 * few]
    values = {i: set() for i in small}
    if small:
        cells = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lower(answer(names[i])).alias("v")) for i in small)))
        rows = df.select(cells.alias("x")).select("x.*").where("v is not null").distinct()
        ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("i").orderBy("v"))).where(F.col("k") <= few)
        for r in ranked.select("i", "v").collect():
            values[r.i].add(r.v)
    out = {}
    for i, c in enumerate(names):
        numeric, held = is_number(kinds[c]), values.get(i)
        scale = held is not None and len(held) <= ORDINAL_MOST and (numeric or any(len(held & set(s)) >= 2 for s in SCALES))
        if not one[f"n{i}"]:
            out[c] = "unknown"
        elif is_filter(c):
            out[c] = "filter_question"
        elif one[f"multi{i}"] >= MULTI_SHARE:
            out[c] = "multi_response"
        elif one[f"json{i}"] >= JSON_SHARE:
            out[c] = "json_range"
        elif re.search(TIME_NAME, c, re.IGNORECASE):
            out[c] = "time_field"
        elif held and any(held <= set(b) for b in BINARY):
            out[c] = "binary"
        elif scale:
            out[c] = "ordinal_scale"
        elif re.search(TEXT_NAME, c, re.IGNORECASE) or (not numeric and one[f"words{i}"] >= FREE_TEXT_WORDS):
            out[c] = "free_text"
        else:
            out[c] = "numeric" if numeric else "categorical"
    return out


def answers(column: Column) -> Column:
    """The distinct trimmed answers of a multiple-answer cell."""
    return F.array_distinct(F.filter(F.transform(F.split(column, r"\|"), lambda x: F.trim(x)), lambda x: x != ""))


def answer_counts(df: DataFrame, column: str) -> DataFrame:
    """(answer, times), most frequent first; an answer counts once a row."""
    need(df, column)
    return df.select(F.explode(answers(answer(column))).alias("answer")).groupBy("answer").agg(F.count("*").alias("times")).orderBy(F.desc("times"), "answer")


def one_hot_answers(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a 0/1 column ``<column>|<answer>`` for each answer, in sorted order."""
    found = [r.answer for r in answer_counts(df, column).select("answer").orderBy("answer").collect()]
    held = answers(answer(column))
    return df.withColumns({f"{column}|{x}": F.coalesce(F.array_contains(held, x).cast("int"), F.lit(0)) for x in found})


def together(df: DataFrame, column: str) -> DataFrame:
    """(a, b, times) of each pair of answers in one cell, a before b. Pairs are made inside the cell, so nothing is joined."""
    need(df, column)
    held = F.array_sort(answers(answer(column)))
    pairs = F.flatten(F.transform(held, lambda x, i: F.transform(F.slice(held, i + 2, F.size(held)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return df.select(F.explode(pairs).alias("x")).groupBy("x.a", "x.b").agg(F.count("*").alias("times"))


def top_together(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return together(df, column).orderBy(F.desc("times"), "a", "b").limit(n)


def json_range(df: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """Columns ``<column>_min``, ``_max``, ``_mid`` (text) and the same with ``_num`` of a cell with a JSON range.

    Bare keys, trailing commas and the known key names are taken; what isn't JSON at all is searched for ``key: value``.
    """
    need(df, column)
    text = answer(column)
    tidy = F.regexp_replace(text, r",\s*([}\]])", "$1")
    parsed = F.from_json(tidy, "map<string,string>", {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true"})
    pairs = F.transform_keys(F.map_filter(parsed, lambda k, v: v.isNotNull()), lambda k, v: F.lower(F.trim(k)))
    # Two spellings of a key in one cell would clash in a map of lower-cased keys.
    safe = F.size(F.array_distinct(F.transform(F.map_keys(parsed), lambda k: F.lower(F.trim(k))))) == F.size(F.map_keys(parsed))
    out = {}
    for part, aliases in ALIASES.items():
        loose = F.nullif(F.regexp_extract(text, rf"(?i)[{{\s,\"']?\b(?:{'|'.join(aliases)})\b[\"']?\s*[:=]\s*[\"']?([^,;}}\"']+)", 1), F.lit(""))
        strict = F.coalesce(*(F.when(safe, F.try_element_at(pairs, F.lit(a))) for a in aliases))
        out[f"{column}_{part}"] = F.trim(F.coalesce(strict, loose))
    rows = df.select(*(keep or df.columns), *(v.alias(k) for k, v in out.items()))
    return rows.withColumns({f"{k}_num": F.col(k).try_cast("double") for k in out})


def text_features(df: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """has_response, char_count, word_count and the cleaned text of a free-text cell."""
    need(df, column)
    text = F.trim(F.regexp_replace(F.regexp_replace(F.col(column), r"[\x00-\x1f\x7f]", " "), r"\s+", " "))
    has = F.coalesce(~F.col(column).isin(_NULL_TEXT) & (text != "") & ~F.lower(text).rlike(REFUSAL), F.lit(False))
    return df.select(*(keep or df.columns), has.alias("has_response"), F.coalesce(F.when(has, F.length(text)), F.lit(0)).alias("char_count"), F.coalesce(F.when(has, F.size(F.split(text, " "))), F.lit(0)).alias("word_count"), F.when(has, text).alias("cleaned"))


def response_level(rate: Column) -> Column:
    return F.when(rate >= 90, "high").when(rate >= 70, "medium").when(rate >= 50, "low").otherwise("critical")


def response_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(position, column, n_total, n_null, n_refused, n_response, rate, level, is_filter). One aggregation."""
    df = clean(df)
    columns = columns or scalar_columns(df)
    kinds = {f.name: f.dataType for f in df.schema}
    refused = lambda c: F.count_if(F.lower(F.trim(F.col(c))).rlike(REFUSAL)) if not is_number(kinds[c]) else F.lit(0).cast("long")
    text = df.select(*(F.col(c).cast("string").alias(c) if not is_number(kinds[c]) else F.col(c) for c in columns))
    one = text.agg(F.count("*").alias("n"), *(x for i, c in enumerate(columns) for x in (F.count(c).alias(f"c{i}"), refused(c).alias(f"r{i}"))))
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"c{i}").alias("present"), F.col(f"r{i}").alias("n_refused"), F.lit(is_filter(c)).alias("is_filter")) for i, c in enumerate(columns)]
    rows = one.select("n", F.explode(F.array(*rows)).alias("x")).select("n", "x.*")
    given = F.col("present") - F.col("n_refused")
    rate = F.round(100 * given / F.greatest("n", F.lit(1)), 1)
    return rows.select("position", "column", F.col("n").alias("n_total"), (F.col("n") - F.col("present")).alias("n_null"), "n_refused", given.alias("n_response"), rate.alias("rate"), response_level(rate).alias("level"), "is_filter")


def ordinal_stats(df: DataFrame, column: str) -> DataFrame:
    """(value, times, share, cumulative, cumulative_share) in order of value."""
    need(df, column)
    counts = clean(df).where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("times"))
    # One row a value of the scale.
    everything = Window.partitionBy()
    running = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.select("value", "times", (F.col("times") / F.sum("times").over(everything)).alias("share"), F.sum("times").over(running).alias("cumulative"), F.sum("times").over(everything).alias("n"))
    return rows.select("value", "times", "share", "cumulative", (F.col("cumulative") / F.col("n")).alias("cumulative_share"))


def ordinal_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: n, values, normalised entropy, ordinal median, mode, and the share of the central values in percent."""
    rows = ordinal_stats(df, column)
    n = F.sum("times")
    numbered = rows.withColumn("i", F.row_number().over(Window.orderBy("value"))).withColumn("k", F.count("*").over(Window.partitionBy()))
    # With four or more values: the two in the middle, of an odd number the lower ones.
    middle = F.floor(F.col("k") / 2)
    central = F.when(F.col("i").between(middle, middle + 1), F.col("share"))
    out = numbered.agg(
        n.alias("n"),
        F.count("*").alias("n_values"),
        (-F.sum(F.col("share") * F.log2(F.col("share") + 1e-12))).alias("entropy"),
        F.min(F.when(F.col("cumulative_share") >= 0.5, F.col("value"))).alias("median"),
        F.min_by("value", F.struct((-F.col("times")).alias("a"), F.col("value"))).alias("mode"),
        F.sum(central).alias("central"),
        F.max("share").alias("most"),
    )
    return out.select("n", "n_values", F.round(F.when(F.col("n_values") > 1, F.col("entropy") / F.log2("n_values")).otherwise(0.0), 4).alias("entropy"), "median", "mode", F.round(100 * F.when(F.col("n_values") >= 4, F.col("central")).otherwise(F.col("most")), 1).alias("centrality"))


def unparented(df: DataFrame) -> DataFrame:
    """(column, parent, n): rows that answer a filter question but not the column before it."""
    names = scalar_columns(df)
    pairs = [(c, names[i - 1]) for i, c in enumerate(names) if i and is_filter(c)]
    if not pairs:
        return df.sparkSession.createDataFrame([], "column string, parent string, n long")
    one = df.agg(*(F.count_if(answer(c).isNotNull() & answer(p).isNull()).alias(f"n{i}") for i, (c, p) in enumerate(pairs)))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(p).alias("parent"), F.col(f"n{i}").alias("n")) for i, (c, p) in enumerate(pairs)))).alias("x")).select("x.*")
    return rows.where("n > 0")


def twin_columns(df: DataFrame, least: float = 0.95) -> DataFrame:
    """(a, b, r) of numeric columns that say nearly the same."""
    if len(numeric_columns(df)) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    return correlations(df).where(F.col("r") >= least).select("a", "b", F.round("r", 4).alias("r"))


def uneven_sections(rates: DataFrame, size: int = 5, spread: float = 30) -> DataFrame:
    """(section, n, lowest, highest) of consecutive columns whose response rates differ much; an incomplete last section is left out."""
    rows = rates.groupBy(F.floor(F.col("position") / size).alias("section")).agg(F.count("*").alias("n"), F.min("rate").alias("lowest"), F.max("rate").alias("highest"))
    return rows.where((F.col("n") == size) & (F.col("highest") - F.col("lowest") >= spread))


def report(df: DataFrame) -> dict[str, object]:
    """All questionnaire analyses of a table: types, and the tables that they call for."""
    types = field_types(df)
    of = lambda kind: [c for c, t in types.items() if t == kind]
    rates = response_rates(df)
    return {
        "types": types,
        "answers": {c: answer_counts(df, c) for c in of("multi_response")},
        "together": {c: top_together(df, c) for c in of("multi_response")},
        "ranges": {c: json_range(df, c, []) for c in of("json_range")},
        "texts": {c: text_features(df, c, []) for c in of("free_text") + of("filter_question")},
        "ordinal": {c: ordinal_summary(df, c) for c in of("ordinal_scale")},
        "rates": rates,
        "unparented": unparented(df),
        "twins": twin_columns(df),
        "sections": uneven_sections(rates),
    }


def summary(found: dict[str, object]) -> str:
    """Counts of the field types in one sentence."""
    kinds: dict[str, int] = {}
    for t in found["types"].values():
        kinds[t] = kinds.get(t, 0) + 1
    return f"{len(found['types'])} columns: " + ", ".join(f"{n} {k}" for k, n in sorted(kinds.items(), key=lambda x: (-x[1], x[0])))
