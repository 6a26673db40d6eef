"""The files that sharding writes hold each row, also those with null or very common keys, within the byte limit."""

from __future__ import annotations

from collections import Counter

from sondage.llm import sharding
from sondage.llm.common import Staging


def test_written_shards(spark):
    rows = [(None, "n" * 30, 1), (None, None, 2), *((1, "x" * 40, i) for i in range(60)), (1, "y" * 150, 3), *((i, "é" * 5, i) for i in range(2, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(3)
    folder = f"{Staging(spark, 't').root}/files"
    out = sharding.written_shards(docs, "doc_id", "text", 100, folder).collect()
    held, count = Counter(), Counter()
    for r in out:
        held[r.shard, r.page] += r.n_bytes
        count[r.shard, r.page] += 1
    assert len(out) == len(rows) and all(v <= 100 or count[k] == 1 for k, v in held.items())
    back = sharding.read_shards(docs, folder).select("doc_id", "text").collect()
    assert Counter(map(tuple, back)) == Counter((i, t) for i, t, _ in rows)
    none = f"{Staging(spark, 't').root}/files"
    assert sharding.written_shards(docs.limit(0), "doc_id", "text", 100, none).collect() == []
    one = f"{Staging(spark, 't').root}/files"
    assert {(r.shard, r.page, r.depth) for r in sharding.written_shards(docs, "doc_id", "text", 10**9, one).collect()} == {("", "0", 0)}


def test_clashing_columns(spark):
    """Extra columns with the names that the operator uses itself are written and read back as they are."""
    names = ["shard", "page", "in_shard", "in_page", "In_Shard_", "hash", "row", "n_bytes", "depth", "bucket", "over", "part", "large", "n", "at", "prefix", "a.b"]
    rows = [(i % 7 if i < 60 else 7, "z" * (i % 40 + 1), *(f"{c}{i}" for c in names)) for i in range(120)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names]).repartition(3)
    folder = f"{Staging(spark, 't').root}/files"
    out = sharding.written_shards(docs, "doc_id", "text", 100, folder)
    assert out.columns == ["doc_id", "n_bytes", "depth", "shard", "page"]
    bare = sharding.shards(docs.select("doc_id", "text"), "doc_id", "text", 100)
    assert Counter((r.doc_id, r.shard) for r in out.collect()) == Counter((r.doc_id, r.shard) for r in bare.collect())
    back = sharding.read_shards(docs, folder)
    assert back.columns == [*docs.columns, "shard_", "page_"]
    assert Counter(tuple(r)[:-2] for r in back.collect()) == Counter(rows)


def test_rows_that_run_again_are_numbered_alike(spark):
    """Rows of one hot key come from a shuffle whose order may change; the pages of two reads of one call agree."""
    docs = spark.createDataFrame([(1, f"{i}" * 9) for i in range(200)], "doc_id long, text string").repartition(4)
    placed = sharding._placed(docs, "doc_id", "text", 100)
    assert any("over" in f for f in placed.inputFiles())
    rows = lambda: Counter((r.row.text, r.shard, r.page) for r in placed.collect())
    assert rows() == rows()
