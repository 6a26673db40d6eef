"""Host-level quality rules over documents.

Each text is measured and judged by the base rules. Failures are summed by host (the ``source`` column); each host's
failure rate is shrunk towards all hosts by a beta prior fitted to the hosts' rates by moments, and a host whose
shrunk rate exceeds ``most`` is rejected with all its documents.

Words are the runs other than space and 0x09-0x0D. Measures: n_words; word_chars, code points in words; n_symbols,
characters of ``#*$%&|<>``; n_dup_lines, lines with a word that equal an earlier line; n_repeat_words, words in
windows of eight words that occur twice or more in the text, the first occurrence included. The base rules fail a
text of fewer than 20 words or with over 30 in 100 words repeated.

Defined cases: null text has no words; a null host is the empty host; repeated rows are each judged and each counted for
their host; extra columns are ignored or carried along; an empty table gives an empty result. With fewer than two
hosts, or hosts of equal rates, the prior is the mean rate with weight ``weight``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondage.llm.common import Staging, small_batches

WINDOW = 8
FEWEST_WORDS, MOST_REPEATED = 20, 30
#: A host with a higher shrunk failure rate is rejected.
MOST_FAILING = 0.5
#: Least and greatest weight of the prior, in documents.
WEIGHT = (1.0, 1000.0)
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def repeated_words(words: list[bytes]) -> int:
    """Words covered by the windows of eight that occur at least twice. Ranks of windows of 1, 2, 4 and 8 words are exact: no hashing of windows."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    for step in (1, 2, 4):
        rank = np.unique(rank[:-step] * (len(words) + 1) + rank[step:], return_inverse=True)[1]
    twice = (np.bincount(rank) > 1)[rank]
    if not twice.any():
        return 0
    change = np.zeros(len(words) + 1, np.int64)
    change[:n] += twice
    change[WINDOW:] -= twice
    return int((np.cumsum(change) > 0).sum())


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    raw = np.frombuffer(text, np.uint8)
    words = text.split()
    points = int(((raw & 0xC0) != 0x80).sum() - ((raw == 32) | ((raw >= 9) & (raw <= 13))).sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), points, int(_SYMBOL[raw].sum()), len(lines) - len(set(lines)), repeated_words(words)


def failing(measures: tuple[int, ...]) -> bool:
    return measures[0] < FEWEST_WORDS or 100 * measures[4] > MOST_REPEATED * measures[0]


def _measures(batch: pa.RecordBatch) -> list[tuple[int, int, int, int, int]]:
    return [measure(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column("text").cast(pa.binary())]


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, host, measures..., base_failed) of each row of ``docs`` (doc_id, text, source)."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.col("text").cast("binary").alias("text"))
    schema = T.StructType([*source.drop("text").schema, *(T.StructField(x, T.LongType()) for x in MEASURES), T.StructField("base_failed", T.BooleanType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _measures(batch)
            columns = [pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [()] * len(MEASURES))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *columns, pa.array([failing(x) for x in rows], pa.bool_())], schema.names)

    return source.mapInArrow(judge, schema)


def passing(docs: DataFrame) -> DataFrame:
    """The rows that pass the base rules, with all columns."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not failing(x) for x in _measures(batch)], pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)


def host_verdicts(rows: DataFrame, most: float = MOST_FAILING) -> DataFrame:
    """(host, host_docs, host_failed, host_rate, host_kept) from (host, base_failed)."""
    hosts = rows.groupBy("host").agg(F.count("*").alias("host_docs"), F.count_if("base_failed").alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"))
    # A beta distribution with mean m and variance v has a + b = m (1 - m) / v - 1.
    weight = F.when(F.coalesce("v", F.lit(0.0)) > 1e-12, F.col("m") * (1 - F.col("m")) / F.greatest("v", F.lit(1e-12)) - 1).otherwise(F.lit(WEIGHT[1]))
    prior = prior.select("m", F.least(F.greatest(weight, F.lit(WEIGHT[0])), F.lit(WEIGHT[1])).alias("w"))
    shrunk = (F.col("host_failed") + F.col("m") * F.col("w")) / (F.col("host_docs") + F.col("w"))
    # The prior is one row, whatever the input.
    return hosts.join(F.broadcast(prior)).select("host", "host_docs", "host_failed", shrunk.alias("host_rate"), (shrunk <= most).alias("host_kept"))


def quality(docs: DataFrame, most: float = MOST_FAILING) -> DataFrame:
    """(doc_id, host, measures..., base_failed, host_rate, kept) of each row of ``docs`` (doc_id, text, source)."""
    rows = Staging(docs.sparkSession, "quality").put(judged(docs), "judged")
    hosts = host_verdicts(rows, most).select("host", "host_rate", "host_kept")
    return rows.join(hosts, "host").select("doc_id", "host", *MEASURES, "base_failed", "host_rate", (~F.col("base_failed") & F.col("host_kept")).alias("kept"))


def keep_quality(docs: DataFrame, most: float = MOST_FAILING) -> DataFrame:
    """The rows that pass the base rules and whose host is kept, with all columns."""
    refused = Staging(docs.sparkSession, "quality").put(host_verdicts(judged(docs), most).where("not host_kept").select("host"), "refused")
    host = F.coalesce(docs["source"].cast("string"), F.lit(""))
    return passing(docs.join(refused, host == refused["host"], "left_anti"))
