"""Cleaning: what a table needs, the actions for it, and the table after them. Actions are lazy DataFrame-to-DataFrame steps."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.operators import summary
from sondage.operators.correlation import STRONG, correlations, ranked_pairs
from sondage.operators.importance import WEAK, importance
from sondage.operators.normality import ALPHA, dagostino
from sondage.operators.profile import column_profile, missing_report, shape, table_profile
from sondage.operators.types import clean, need, nested_keys, number, numeric_columns, scalar_columns, text_columns

#: Values of lambda that one pass of the Yeo-Johnson fit evaluates for each column.
GRID = 21


@dataclass(frozen=True)
class Context:
    """Columns by what they need, worked out once on the original table."""

    incomplete: list[str] = field(default_factory=list)
    critical: list[str] = field(default_factory=list)
    moderate: list[str] = field(default_factory=list)
    skewed: list[str] = field(default_factory=list)
    weak: list[str] = field(default_factory=list)
    not_normal: list[str] = field(default_factory=list)
    strong_pairs: list[tuple[str, str]] = field(default_factory=list)
    n_duplicates: int = 0
    text: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)


def flags(df: DataFrame) -> DataFrame:
    """(column, completeness, skewness, score, p_value, and the flags incomplete, critical, moderate, skewed, weak, not_normal)."""
    df = clean(df)
    numeric = numeric_columns(df)
    found = summary.column_ranges(df, numeric) if numeric else None
    rows = missing_report(df).select("column", "completeness").join(importance(df, found).select("column", "score"), "column", "left")
    if numeric:
        skew = shape(found, numeric).select("column", F.round("skewness", 4).alias("skewness"))
        rows = rows.join(skew, "column", "left").join(dagostino(df, numeric, found).select("column", "p_value"), "column", "left")
    else:
        rows = rows.withColumns({"skewness": F.lit(None).cast("double"), "p_value": F.lit(None).cast("double")})
    c = F.col("completeness")
    tests = {"incomplete": c < 80, "critical": c < 50, "moderate": (c >= 50) & (c < 80), "skewed": F.abs("skewness") > 1, "weak": F.col("score") < WEAK, "not_normal": F.col("p_value") < ALPHA}
    return rows.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in tests.items()})


def context(df: DataFrame) -> Context:
    rows = flags(df).orderBy("column").collect()  # one row a column
    order = {c: i for i, c in enumerate(df.columns)}
    of = lambda flag: sorted((r["column"] for r in rows if r[flag]), key=order.get)
    pairs = [(r.a, r.b) for r in ranked_pairs(correlations(df), STRONG).collect()] if len(numeric_columns(df)) > 1 else []
    return Context(of("incomplete"), of("critical"), of("moderate"), of("skewed"), of("weak"), of("not_normal"), pairs, table_profile(df).first().n_duplicates, text_columns(df), numeric_columns(df))


def drop_duplicates(df: DataFrame, found: Context | None = None) -> DataFrame:
    """One row of each set of rows that are equal in all columns, nested ones too."""
    keys = {f"__k{i}": k for i, k in enumerate(nested_keys(df))}
    return df.withColumns(keys).dropDuplicates([*scalar_columns(df), *keys]).drop(*keys) if keys else df.dropDuplicates()


def drop_critical_missing(df: DataFrame, found: Context) -> DataFrame:
    return df.drop(*found.critical)


def drop_low_importance(df: DataFrame, found: Context) -> DataFrame:
    return df.drop(*found.weak)


def fill_values(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """What replaces a null: the median of a number, else the most frequent value (of equals the smallest), ``INCONNU`` if there is none."""
    df = clean(df)
    need(df, *columns)
    numeric = [c for c in columns if c in numeric_columns(df)]
    other = [c for c in columns if c not in numeric]
    out: dict[str, object] = {}
    if numeric:
        out |= {c: values[0.5] for c, values in summary.column_quantiles(df, numeric, [0.5]).items()}
    if other:
        out |= {r["column"]: r["mode"] if r["mode"] is not None else "INCONNU" for r in column_profile(df, other).collect()}
    return out


def fill_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    df = clean(df)
    kinds = {f.name: f.dataType for f in df.schema}
    values = fill_values(df, columns)
    # A median may be no integer: integral columns become double, as they would with missing cells.
    return df.withColumns({c: F.coalesce(number(c), F.lit(v)) if c in numeric_columns(df) else F.coalesce(F.col(c), F.lit(v).try_cast(kinds[c])) for c, v in values.items()})


def impute_moderate_missing(df: DataFrame, found: Context) -> DataFrame:
    return fill_nulls(df, [c for c in found.moderate if c in df.columns])


def log1p(df: DataFrame, columns: list[str]) -> DataFrame:
    """ln(1 + x), shifted to positive values where a column has negative ones."""
    df = clean(df)
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    need(df, *columns, numeric=True)
    return df.withColumns({c: F.log1p(number(c) + s) for c, s in shifts(df, columns).items()})


def shifts(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """What is added to a column so that it has no negative values; columns without values are left out."""
    if not columns:
        return {}
    low = df.agg(*(F.min(number(c)).alias(f"m{i}") for i, c in enumerate(columns))).first()
    return {c: abs(low[f"m{i}"]) + 1 if low[f"m{i}"] < 0 else 0.0 for i, c in enumerate(columns) if low[f"m{i}"] is not None}


def transform_skewed(df: DataFrame, found: Context) -> DataFrame:
    return log1p(df, found.skewed)


def yeo_johnson(x: Column, power: float) -> Column:
    up = F.log1p(F.greatest(x, F.lit(0.0))) if abs(power) < 1e-9 else (F.pow(F.greatest(x, F.lit(0.0)) + 1, F.lit(power)) - 1) / power
    down = -F.log1p(F.greatest(-x, F.lit(0.0))) if abs(power - 2) < 1e-9 else -(F.pow(F.greatest(-x, F.lit(0.0)) + 1, F.lit(2 - power)) - 1) / (2 - power)
    return F.when(x >= 0, up).when(x < 0, down)


def yeo_johnson_powers(df: DataFrame, columns: list[str], rounds: int = 4) -> dict[str, float]:
    """The power of greatest likelihood of each column, by a grid that narrows around the best; each round is one aggregation."""
    df = clean(df)
    span = {c: (-4.0, 6.0) for c in columns}
    best = {c: 1.0 for c in columns}
    for _ in range(rounds):
        grids = {c: [lo + (hi - lo) * k / (GRID - 1) for k in range(GRID)] for c, (lo, hi) in span.items()}
        exprs = []
        for i, c in enumerate(columns):
            exprs += [F.count(number(c)).alias(f"n{i}"), F.sum(F.signum(number(c)) * F.log1p(F.abs(number(c)))).alias(f"s{i}")]
            exprs += [F.var_pop(yeo_johnson(number(c), p)).alias(f"v{i}_{k}") for k, p in enumerate(grids[c])]
        one = df.agg(*exprs).first()
        for i, c in enumerate(columns):
            likely = [(-(one[f"n{i}"] / 2) * math.log(v) + (p - 1) * one[f"s{i}"], -abs(p - 1), p) for k, p in enumerate(grids[c]) if (v := one[f"v{i}_{k}"]) and v > 0 and v != float("inf")]
            if likely:
                best[c] = max(likely)[2]
                step = (span[c][1] - span[c][0]) / (GRID - 1)
                span[c] = (best[c] - step, best[c] + step)
    return best


def standardise(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Population z-scores of numeric columns; 0 where there is no spread."""
    df = clean(df)
    columns = [c for c in (columns if columns is not None else numeric_columns(df)) if c in df.columns]
    if not columns:
        return df
    one = df.agg(*(x for i, c in enumerate(columns) for x in (F.avg(number(c)).alias(f"m{i}"), F.stddev_pop(number(c)).alias(f"s{i}")))).first()
    z = lambda i, c: (number(c) - F.lit(one[f"m{i}"])) / F.lit(one[f"s{i}"]) if one[f"s{i}"] else F.when(F.col(c).isNotNull(), 0.0)
    return df.withColumns({c: z(i, c) for i, c in enumerate(columns)})


def normalise_yeo(df: DataFrame, found: Context) -> DataFrame:
    """Yeo-Johnson and z-scores of the columns that aren't normal."""
    columns = [c for c in found.not_normal if c in df.columns]
    if not columns:
        return df
    powers = yeo_johnson_powers(df, columns)
    return standardise(clean(df).withColumns({c: yeo_johnson(number(c), p) for c, p in powers.items()}), columns)


def one_hot(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column replaced by a boolean column ``<column>_<value>`` a value, at the end; nulls are false in all."""
    need(df, *columns)
    out = df
    for c in columns:
        values = [r[0] for r in df.where(F.col(c).isNotNull()).select(c).distinct().orderBy(c).collect()]  # as many as the columns asked for
        out = out.withColumns({f"{c}_{v}": F.coalesce(F.col(c) == F.lit(v), F.lit(False)) for v in values}).drop(c)
    return out


def encode_categorical(df: DataFrame, found: Context) -> DataFrame:
    return one_hot(df, [c for c in found.text if c in df.columns])


def standardise_all(df: DataFrame, found: Context) -> DataFrame:
    return standardise(df)


ACTIONS: dict[str, tuple[Callable[[DataFrame, Context], DataFrame], Callable[[Context], bool]]] = {
    "drop_duplicates": (drop_duplicates, lambda c: c.n_duplicates > 0),
    "drop_critical_missing": (drop_critical_missing, lambda c: bool(c.critical)),
    "impute_moderate_missing": (impute_moderate_missing, lambda c: bool(c.moderate)),
    "normalize_yeo": (normalise_yeo, lambda c: bool(c.not_normal)),
    "transform_skewed": (transform_skewed, lambda c: bool(c.skewed)),
    "drop_low_importance": (drop_low_importance, lambda c: bool(c.weak)),
    "encode_categorical": (encode_categorical, lambda c: bool(c.text)),
    "standardize": (standardise_all, lambda c: bool(c.numeric)),
}
#: The order in which a table is best prepared.
SUGGESTED_ORDER = ["duplicates", "missing values", "outliers", "distributions", "encoding of text columns", "scaling", "fewer dimensions", "training and test rows"]


def catalog(found: Context) -> list[tuple[str, bool]]:
    """Each action, and whether the table needs it."""
    return [(name, needed(found)) for name, (_, needed) in ACTIONS.items()]


def advice(found: Context, shown: int = 4) -> list[dict[str, str]]:
    """The actions that the table needs, with priority, category, label, justification and impact."""
    some = lambda columns: ", ".join(columns[:shown])
    texts = {
        "drop_duplicates": ("high", "quality", f"Drop {found.n_duplicates} duplicate rows", "Duplicates distort statistics and models.", "high"),
        "drop_critical_missing": ("high", "missing values", f"Drop {len(found.critical)} columns with more than 50 % missing", f"Columns: {some(found.critical)}.", "high"),
        "impute_moderate_missing": ("medium", "missing values", f"Fill {len(found.moderate)} columns with 20 to 50 % missing", f"Median of numbers, else the mode: {some(found.moderate)}.", "medium"),
        "normalize_yeo": ("medium", "normality", f"Yeo-Johnson transformation of {len(found.not_normal)} columns that aren't normal", f"Columns: {some(found.not_normal)}.", "medium"),
        "transform_skewed": ("medium", "distribution", f"ln(1 + x) of {len(found.skewed)} skewed columns", f"|skewness| > 1: {some(found.skewed)}.", "medium"),
        "drop_low_importance": ("low", "selection", f"Drop {len(found.weak)} columns of low importance (score below {WEAK} %)", f"Columns: {some(found.weak)}.", "low"),
        "encode_categorical": ("low", "encoding", f"One-hot encoding of {len(found.text)} text columns", "Models need numbers.", "low"),
        "standardize": ("low", "scaling", f"z-scores of {len(found.numeric)} numeric columns", "Distances and penalised models need equal scales.", "low"),
    }
    return [{"id": a, **dict(zip(("priority", "category", "label", "justification", "impact"), texts[a], strict=True))} for a, needed in catalog(found) if needed]


def indicators(df: DataFrame) -> DataFrame:
    """One row: critical problems (over 20 % of all cells missing, duplicates, skewed columns), columns to treat (incomplete or weak ones), strongly
    correlated pairs, and columns that aren't normal."""
    rows = flags(df).agg(*(F.count_if(c).alias(c) for c in ("incomplete", "skewed", "weak", "not_normal")))
    both = rows.join(table_profile(df).select("completeness", "n_duplicates"))
    if len(numeric_columns(clean(df))) > 1:
        both = both.join(correlations(df).agg(F.count_if(F.abs("r") >= STRONG).alias("redundant_pairs")))
    else:
        both = both.withColumn("redundant_pairs", F.lit(0).cast("long"))
    some = lambda c: c.cast("int")
    critical = some(100 - F.col("completeness") > 20) + some(F.col("n_duplicates") > 0) + some(F.col("skewed") > 0)
    return both.select(critical.alias("critical_problems"), (F.col("incomplete") + F.col("weak")).alias("columns_to_treat"), "redundant_pairs", F.col("not_normal").alias("not_normal_columns"))


def _entries(action: str, before: DataFrame, found: Context) -> list[str]:
    """What an action does to ``before``, with the values that it uses."""
    here = lambda columns: [c for c in columns if c in before.columns]
    if action == "drop_duplicates":
        n = table_profile(before).first().n_duplicates
        return [f"duplicates dropped: {n} rows"]
    if action == "drop_critical_missing":
        return [f"columns with over 50 % missing dropped: {', '.join(here(found.critical))}"]
    if action == "impute_moderate_missing":
        numeric = numeric_columns(before)
        return [f"{'median' if c in numeric else 'mode'} filled in: {c} ({v:.4f})" if c in numeric else f"mode filled in: {c} ({v})" for c, v in fill_values(before, here(found.moderate)).items()] if here(found.moderate) else []
    if action == "normalize_yeo":
        return [f"Yeo-Johnson: {', '.join(here(found.not_normal))}"] if here(found.not_normal) else []
    if action == "transform_skewed":
        return [f"ln(1 + x): {c}" if not s else f"ln(1 + x + {s:.2f}): {c}" for c, s in shifts(clean(before), here(found.skewed)).items()]
    if action == "drop_low_importance":
        return [f"columns of low importance dropped: {', '.join(here(found.weak))}"]
    if action == "encode_categorical":
        return [f"one-hot encoded: {', '.join(here(found.text))}"] if here(found.text) else []
    return [f"standardised: {len(numeric_columns(before))} columns"] if numeric_columns(before) else []


def apply_actions(df: DataFrame, actions: list[str], found: Context | None = None) -> tuple[DataFrame, list[str]]:
    """``df`` after the actions in the caller's order, and a journal of what was done. The context is that of the original table; unknown actions do nothing."""
    found = found or context(df)
    journal: list[str] = []
    for a in actions:
        if a in ACTIONS:
            journal += _entries(a, df, found)
            df = ACTIONS[a][0](df, found)
    return df, journal


def preview(df: DataFrame, rows: int = 10) -> list[dict]:
    """The first rows as dictionaries."""
    return [r.asDict() for r in clean(df).limit(rows).collect()]


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """(measure, before, after, change) of the profiles of two tables."""
    names = ["n_rows", "n_columns", "n_missing", "completeness", "n_duplicates", "n_numeric", "n_text"]
    long = lambda df, name: table_profile(df).select(F.explode(F.array(*(F.struct(F.lit(x).alias("measure"), F.col(x).cast("double").alias(name)) for x in names))).alias("x")).select("x.*")
    change = F.col("after") - F.col("before")
    return long(before, "before").join(long(after, "after"), "measure").select("measure", "before", "after", F.when(change == 0, "=").otherwise(F.format_string("%+.2f", change)).alias("change"))


def missing_before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column, before, after) missing cells of the columns of both tables."""
    return missing_report(before).select("column", F.col("n_missing").alias("before")).join(missing_report(after).select("column", F.col("n_missing").alias("after")), "column")


def detected_steps(before: DataFrame, after: DataFrame) -> list[str]:
    """The cleaning that the profiles of two tables tell of."""
    a, b = table_profile(before).first(), table_profile(after).first()
    steps = []
    if a.n_missing > b.n_missing:
        steps.append(f"imputation: {a.n_missing} missing cells before, {b.n_missing} after")
    if a.n_duplicates > b.n_duplicates or a.n_rows > b.n_rows:
        steps.append(f"deduplication: {a.n_rows - b.n_rows} rows fewer")
    if b.n_numeric > a.n_numeric and b.n_text < a.n_text:
        steps.append("encoding of text columns")
    if gone := [c for c in before.columns if c not in after.columns]:
        steps.append("dropped columns: " + ", ".join(gone))
    return steps or ["no cleaning is visible"]
