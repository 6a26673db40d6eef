"""One query for each operator of this subpackage, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.llm import byte_bpe, collocations, decontaminate, jaccard_join, line_dedup, merkle, near_dedup, oracles, quality, sharding, token_counts, token_files, tool_calls, url_filter
from sondage.llm.common import Staging, table

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
SCHEMAS = {"reply": {"properties": {"turn": "integer", "prompt": "string"}, "required": ["turn", "prompt"]}}
#: Byte limit of a shard.
SHARD_BYTES = 1 << 20


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *quality.MEASURES, "base_failed", "kept")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(byte_bpe.encoded(table(spark, sf_dir, "documents")))


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tool_calls.linked(*tool_calls.turns_as_calls(table(spark, sf_dir, "conversations"), "reply"), SCHEMAS)
    return rows.select("conv_id", "turn", "topo_rank", "cyclic", "result_turn", F.sha2("content", 256).alias("content_sha256"), F.sha2("canonical", 256).alias("canonical_sha256"), F.size("errors").cast("long").alias("n_errors"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(line_dedup.dedup_lines(table(spark, sf_dir, "documents")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{Staging(spark, 'shards').root}/files"
    return sharding.written_shards(table(spark, sf_dir, "documents"), "doc_id", "text", SHARD_BYTES, folder)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), [url_filter.Rule.parse(*x) for x in RULES]).drop("p_blocked")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{Staging(spark, 'ids').root}/files"
    token_files.write(table(spark, sf_dir, "documents"), folder)
    return token_files.digests(token_files.read(spark, folder))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


_ALL = (op1_quality_rules, op2_tool_calls, op3_benchmark_decontamination, op4_minhash_near_dedup, op5_byte_bpe, op6_line_dedup, op7_token_counts, op8_sharding, op9_url_filter, op10_token_files, op11_merkle_manifest, op12_jaccard_join, op13_phrase_collocations)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op1_quality_rules": oracles.OP1, "op2_tool_calls": oracles.OP2, "op3_benchmark_decontamination": oracles.OP3, "op4_minhash_near_dedup": oracles.OP4, "op8_sharding": oracles.op8(SHARD_BYTES), "op11_merkle_manifest": oracles.OP11, "op12_jaccard_join": oracles.OP12, "op13_phrase_collocations": oracles.OP13}
