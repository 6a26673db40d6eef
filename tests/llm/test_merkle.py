"""The Merkle manifest against trees built whole in memory, and in DuckDB."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sondage.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, key string, leaf string, pos long, proof string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """(root, for each node the (before, after) of each level)."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(place):
            run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
            paths[i].append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
            place[i] = at // 16
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def plain(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = own, *tree([leaf(*r) for r in own])
    root, tops = tree([trees[s][1] for s in order])
    out = []
    for s, above in zip(order, tops, strict=True):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths, strict=True):
            steps = path + above
            text, bad = r[4], r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            if bad and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            h = leaf(*r[:4], text)
            for before, after in steps:
                h = sha(before + h + after)
            out.append((r[0] if r[0] is not None else -1, leaf(*r), subroot, root, sha("".join(b + a for b, a in steps)), h, h == root))
    return sorted(out)


def found(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def rows_of(sizes, seed=3):
    rng = random.Random(seed)
    rows, n = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            n += rng.randrange(1, 4)
            text = rng.choice([None, "", "plain", "Été À B", "x" * rng.randrange(50), "LOUD 🎉"])
            rows.append((n, source, rng.choice([None, "en", "dé"]), rng.choice([None, 0, 12]), text))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "l", 1, "p") for r in rows], SCHEMA).repartition(3)


def test_against_whole_trees(spark):
    rows = rows_of({None: 3, "": 1, "a": 17, "B": 16, "é": 257, "z": 40, "one": 1, **{f"s{i}": 1 + i % 3 for i in range(20)}})
    rows += [(None, "a", "en", 1, "no id"), (None, "a", "en", 1, "No id"), *[(7, "z", "en", 1, "Same row")] * 5, (8, "z", "en", 1, "w " * 200_000 + "End")]
    assert found(merkle.verified(frame(spark, rows))) == plain(rows)


@pytest.mark.parametrize("size", [4096, 4097, 4113, 8200])
def test_several_layers(spark, size):
    rows = [(i, "a", "en", 1, f"Text {i}") for i in range(size)] + [(i, "b", "en", 1, "t") for i in range(40)]
    assert found(merkle.verified(frame(spark, rows))) == plain(rows)


def test_many_sources_in_small_blocks(spark, monkeypatch):
    """Three layers in both trees."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "SPAN", 16)
    rows = [(i, "hot", None, i, "T") for i in range(600)] + [(1000 + i, f"s{i}", None, i, "T") for i in range(270)]
    assert found(merkle.verified(frame(spark, rows))) == plain(rows)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_IDS", 0)
    rows = rows_of({"a": 30, "b": 2})
    assert found(merkle.verified(frame(spark, rows))) == plain(rows)


@pytest.mark.parametrize("count", [1, 15, 16, 17, 255, 256, 300, 4096])
def test_traversal_emits_each_path(count):
    leaves = [sha(str(i)) for i in range(count)]
    root, paths = tree(leaves)
    levels = len(paths[0])
    assert [list(x) for x in merkle.traversal(leaves, levels)] == paths
    assert merkle.top(leaves, None) == root


def test_subtrees_hold_little(monkeypatch):
    """Besides the leaves of the block, existing and desired subtrees and their stacks stay within three runs a level."""
    most = 0
    grow = merkle.Subtree.grow

    def watched(self):
        nonlocal most
        grow(self)
        most = max(most, sum(map(len, self.stack)))

    monkeypatch.setattr(merkle.Subtree, "grow", watched)
    assert sum(1 for _ in merkle.traversal([sha(str(i)) for i in range(4096)], 3)) == 4096
    assert most <= 3 * 16


def test_proofs_carry_columns_and_places(spark):
    rows = rows_of({"a": 20, None: 5})
    docs = frame(spark, rows)
    got = merkle.proofs(docs, {"key": docs["text"], "place2": docs["doc_id"] * 2}).collect()
    texts = {r[0]: r[4] for r in rows}
    assert all(r["key"] == texts[r.doc_id] and r.place2 == 2 * r.doc_id for r in got)
    assert sorted(r.place for r in got) == sorted([*range(20), *range(5)])
    for r in got:
        h = r.leaf
        for step in r.proof:
            h = sha(step.before + h + step.after)
        assert h == r.root


def test_manifest_has_a_row_a_source(spark):
    rows = rows_of({"a": 20, None: 5, "": 2})
    got = {r.source: (r.subroot, r.root) for r in merkle.manifest(frame(spark, rows)).collect()}
    whole = {r[1]: None for r in rows}
    assert set(got) == set(whole) and len({x[1] for x in got.values()}) == 1


def test_empty_table(spark):
    assert merkle.verified(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_table_in_sql(spark, sf_dir):
    import duckdb

    from sondage.llm.queries import ORACLES, QUERIES

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = c.execute(ORACLES["op11_merkle_manifest"])
    names = [x[0] for x in want.description]
    rows = QUERIES["op11_merkle_manifest"](spark, sf_dir).select(*names)
    assert rows.where(~F.col("verified")).count() > 0
    assert sorted(tuple(r) for r in rows.collect()) == sorted(want.fetchall())
