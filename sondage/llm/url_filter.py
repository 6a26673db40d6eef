"""URL verdicts: a rule list first, then gradient-boosted trees on lexical features.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path follows, up to
``?``, ``#`` or the end; without ``://`` both are empty. A rule names a host with all its subdomains and a path prefix; of the rules
that fit a URL the longest decides. The other URLs are judged by trees trained on labelled URLs: length, depth, digit ratio,
entropy, parameter counts, and counts and block rate of the host's last two labels among the labelled URLs.

The counts and rates are taken over all labelled rows. Only the trees are fitted on a sample of about ``SAMPLE`` labelled rows, half of it at
most of each verdict while both have more, chosen by a hash of the row, so that fitting costs the same at every size; all rows are judged.

Defined cases: a null URL has empty host and path, no rule and is judged by its features (length 0); without labelled URLs of
both kinds the method allows all; repeated rows are each judged; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.llm.common import BROADCAST_IDS, Staging

#: Labelled rows that the trees are fitted on, about.
SAMPLE = 20_000
TREES, DEPTH, SEED = 20, 4, 7
#: Longest rule list that is sent along as an expression.
MOST_RULES = 1000
FEATURES = ["length", "host_length", "depth", "host_labels", "digit_ratio", "entropy", "hyphens", "n_params", "query_length", "longest_part", "has_fragment", "is_https", "suffix_count", "suffix_rate"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(verdict, host.lower(), slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    split = r"^(?s).*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, split, 1), _UPPER, _LOWER), F.regexp_extract(url, split, 2)


def rule_for(rules: list[Rule], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, else nulls. Rules of one text: the first counts."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    text = verdict = None
    dotted = F.concat(F.lit("."), F.col(host))
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = dotted.endswith("." + r.host) & F.col(path).startswith(r.path)
        text = F.when(fits, r.text) if text is None else text.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    return (text, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def with_features(pages: DataFrame) -> DataFrame:
    """``pages`` (url, host, path) with the lexical features that need no other rows, and ``suffix``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    length = F.length(url)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    letters = F.array_distinct(F.split(url, "(?s)(?!^)"))
    share = F.transform(letters, lambda c: (length - F.length(F.replace(url, c, F.lit("")))) / F.greatest(length, F.lit(1)) / F.greatest(F.length(c), F.lit(1)))
    entropy = F.aggregate(share, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return pages.select(
        "*",
        F.substring_index("host", ".", -2).alias("suffix"),
        length.cast("double").alias("length"),
        F.length("host").cast("double").alias("host_length"),
        F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double").alias("depth"),
        F.size(F.split("host", r"\.")).cast("double").alias("host_labels"),
        (F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(length, F.lit(1))).alias("digit_ratio"),
        entropy.alias("entropy"),
        (length - F.length(F.replace(url, F.lit("-"), F.lit("")))).cast("double").alias("hyphens"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")).alias("n_params"),
        F.length(query).cast("double").alias("query_length"),
        F.array_max(F.transform(F.split("path", "/"), F.length)).cast("double").alias("longest_part"),
        F.contains(url, F.lit("#")).cast("double").alias("has_fragment"),
        F.startswith(F.lower(url), F.lit("https")).cast("double").alias("is_https"),
    )


def _sample(labelled: DataFrame, allowed: int, blocked: int, sample: int) -> DataFrame:
    """About ``sample`` rows (url, host, path, blocked), by a hash of page_id and URL, of each verdict up to half; what one verdict leaves free goes to the other.

    A verdict of few rows is taken whole; of the other the row with the smallest hash is always in, so neither verdict is missing.
    """
    part = F.pmod(F.xxhash64(*(c for c in ("page_id", "url") if c in labelled.columns), F.lit(SEED)), F.lit(1_000_000_000))
    rows = labelled.select("url", "host", "path", "blocked", part.alias("part"))
    half = sample / 2
    most = {True: max(half, sample - allowed), False: max(half, sample - blocked)}
    share = {v: int(1_000_000_000 * min(1.0, most[v] / n) + 0.5) for v, n in ((True, blocked), (False, allowed))}
    least = dict(rows.groupBy("blocked").agg(F.min("part")).collect())
    bound = {v: max(share[v], least[v] + 1) for v in share}
    return rows.where(F.col("part") < F.when(F.col("blocked"), bound[True]).otherwise(bound[False])).drop("part")


class UrlModel:
    """Trees and suffix statistics, fitted on labelled URLs (url, host, path, blocked, and page_id if there is one)."""

    def __init__(self, labelled: DataFrame, sample: int = SAMPLE) -> None:
        stage = Staging(labelled.sparkSession, "urls")
        self.model = None
        sums = labelled.groupBy(F.substring_index("host", ".", -2).alias("suffix")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("blocked").cast("long")), F.lit(0)).alias("k"))
        sums = stage.put(sums, "suffixes")
        suffixes, count, blocked = sums.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
        if not 0 < blocked < count:
            return
        self.suffixes = sums.select("suffix", F.col("n").cast("double").alias("suffix_count"), ((F.col("k") + 1) / (F.col("n") + 2)).alias("suffix_rate"))
        self.few = suffixes <= BROADCAST_IDS
        rows = self._with_suffix(with_features(stage.put(_sample(labelled, count - blocked, blocked, sample), "sample")))
        self.assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
        training = self.assembler.transform(rows).select("features", F.col("blocked").cast("double").alias("label")).coalesce(2)
        self.model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED).fit(training)

    def _with_suffix(self, rows: DataFrame) -> DataFrame:
        # One row for each suffix of a labelled host, counted before.
        rows = rows.join(F.broadcast(self.suffixes) if self.few else self.suffixes, "suffix", "left")
        return rows.withColumns({"suffix_count": F.coalesce("suffix_count", F.lit(0.0)), "suffix_rate": F.coalesce("suffix_rate", F.lit(0.5))})

    def blocked(self, pages: DataFrame) -> DataFrame:
        """``pages`` (url, host, path, ...) with ``blocked`` and its probability."""
        if self.model is None:
            return pages.withColumns({"blocked": F.lit(False), "p_blocked": F.lit(0.0)})
        names = pages.columns
        rows = self.model.transform(self.assembler.transform(self._with_suffix(with_features(pages))))
        return rows.select(*names, (F.col("prediction") > 0.5).alias("blocked"), vector_to_array("probability")[1].alias("p_blocked"))


def judged(pages: DataFrame, rules: list[Rule], sample: int = SAMPLE) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_blocked) of each row of ``pages`` (page_id, url).

    The URLs that a rule decides are the labelled ones.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    text, verdict = rule_for(rules)
    rows = rows.withColumns({"rule": text, "by_rule": verdict})
    model = UrlModel(rows.where("by_rule is not null").select("page_id", "url", "host", "path", (F.col("by_rule") == "block").alias("blocked")), sample)
    method = F.when(F.col("blocked"), "block").otherwise("allow")
    return model.blocked(rows).select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), "p_blocked")
