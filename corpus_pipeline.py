"""The documents through five operators: quality rules, line dedup, near-duplicates, decontamination, byte-level BPE.

Each stage takes the documents that its predecessor kept and returns those that it keeps, with the columns of
``documents``; the last returns each document's token digests. Between the stages the documents are written and read again.

Defined cases, in all stages: a null text has no words, so quality rules drop it, and every other stage keeps it as it is; an empty text is
treated alike; repeated rows stay or go together, save for copies of lines, of which the first by (doc_id, line number) stays, and copies of documents, of
which the smallest doc_id stays with all its rows; columns beyond those of ``documents`` are carried along, whatever their names; an empty table gives an
empty result. ``doc_id`` is an integer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.llm import byte_bpe, decontaminate, line_dedup, near_dedup, quality
from sondage.llm.common import Staging, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose host is rejected, go."""
    return quality.keep_quality(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Duplicate lines go from the texts; a document of which no word is left goes with them. ``n_chars`` follows the text."""
    rows = line_dedup.dedup_lines(docs)
    rows = rows.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return rows.select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document that is left."""
    return byte_bpe.digests(byte_bpe.encoded(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("byte-level BPE", byte_level_bpe),
]

#: SQL can express neither the fuzzy line groups nor the token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    stage = Staging(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage.put(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
