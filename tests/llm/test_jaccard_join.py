"""The Jaccard join against all pairs of full sets, and in DuckDB."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from sondage.llm import jaccard_join

SCHEMA = "doc_id long, text string, id string, key string, digest string, component string"


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else {tuple(words)} if words else set()


def plain(rows, percent=85):
    sets, root = {}, {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    items = [(d, shingles(t)) for d, t in rows if d is not None]
    for i, (a, x) in enumerate(items):
        for b, y in items[i + 1 :]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    for d, t in rows:
        sets.setdefault(d, []).append(len(shingles(t)))
    return sorted((d, len(shingles(t)), find(d)) for d, t in rows if d is not None)


def found(spark, rows, percent=85):
    docs = spark.createDataFrame([(d, t, "i", "k", "g", "c") for d, t in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in jaccard_join.jaccard_components(docs, percent).collect() if r.doc_id is not None)


def near_texts(seed, sizes, copies):
    """Texts of so many words with copies in which some words change, so that similarities lie around the threshold."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for size in sizes:
        base = [rng.choice(words) for _ in range(size)]
        rows.append(" ".join(base))
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, size // 18 + 1))):
                at = rng.randrange(len(own)) if rng.random() < 0.6 else rng.choice([0, len(own) - 1])
                match rng.randrange(3):
                    case 0:
                        own[at] = rng.choice(words)
                    case 1:
                        del own[at]
                    case 2:
                        own.insert(at, rng.choice(words))
                if not own:
                    own = ["x"]
            rows.append("  ".join(own).upper() if rng.random() < 0.2 else " ".join(own))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_small_and_large_sets(spark):
    rows = near_texts(1, [*range(1, 40), 60, 80, 120, 200], 8)
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("edge", [0, 7, 14, 20])
def test_any_boundary_gives_the_same(spark, monkeypatch, edge):
    monkeypatch.setattr(jaccard_join, "boundary", lambda *x: edge)
    rows = near_texts(2, range(5, 29), 6)
    assert found(spark, rows) == plain(rows)


def test_frequent_shingles_come_last(spark, monkeypatch):
    """A passage in nearly all texts: sets still meet, and the lists of the passage hold few."""
    monkeypatch.setattr(jaccard_join, "FREQUENT", 8)
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = []
    for _ in range(60):
        own = " ".join(f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 60)))
        rows += [f"{own} {passage}", f"{own} {passage} {rng.randrange(9)}", f"{passage} {own}"]
    rows = list(enumerate(rows))
    assert found(spark, rows) == plain(rows)
    stage = jaccard_join.Staging(spark, "test")
    order = jaccard_join.frequent(spark.createDataFrame(rows, "doc_id long, text string"), stage)
    hashes = next(jaccard_join.shingle_sets([passage.encode()], width=4))[0]
    assert (order.of(hashes) >= 180).all()


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A"), (6, "a b c"), (7, "A  b\tc"), (8, "a b c d"), (9, "a b c d"), (10, "d c b a"), (11, "x " * 50_000), (12, "X " * 9), (7, "A  b\tc"), (13, "été d'été un deux trois"), (14, "ÉTÉ d'été un deux trois")]
    got = found(spark, rows)
    assert got == plain(rows)
    docs = spark.createDataFrame([(None, "a b c d", "", "", "", ""), (1, "a b c d", "", "", "", "")], SCHEMA)
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard_join.jaccard_components(docs).collect()) == [(0, 1, 1), (1, 1, 1)]


def test_many_equal_and_near_copies(spark, monkeypatch):
    monkeypatch.setattr("sondage.llm.linking.BLOCK", 16)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randrange(1, 6)):
            own[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(base)) for i in range(60)]
    assert found(spark, rows) == plain(rows)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr("sondage.llm.common.BROADCAST_IDS", 0)
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    rows = near_texts(3, [6, 12, 30], 5)
    assert found(spark, rows) == plain(rows)


def test_few_frequent_told_apart(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 2)
    monkeypatch.setattr(jaccard_join, "MOST_FREQUENT", 3)
    rows = near_texts(6, [10, 25, 40], 6)
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("percent", [80, 85, 95, 100])
def test_percent(spark, percent):
    rows = near_texts(7, [7, 12, 20, 45, 90], 6)
    assert found(spark, rows, percent) == plain(rows, percent)


def test_percent_is_bounded(spark):
    with pytest.raises(ValueError, match="80"):
        jaccard_join.jaccard_components(spark.createDataFrame([], SCHEMA), 79)


def test_empty_table(spark):
    assert jaccard_join.jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_subsets_meet_exactly_where_sets_are_linked():
    """Light sets that are linked share a subset key, for all sizes up to the boundary."""
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
    for n in range(1, 21):
        for m in range(n, min(20, 100 * n // 85 + 2) + 1):
            for shared in range(max(0, n - 4), n + 1):
                a = np.sort(pool[:n])
                b = np.sort(np.concatenate([pool[:shared], pool[200 : 200 + m - shared]]))
                keys = [set(jaccard_join.subset_keys(x, 20, 85).tolist()) for x in (a, b)]
                assert keys[0] & keys[1] or 100 * shared < 85 * (n + m - shared), (n, m, shared)


def test_bound_is_below_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(300):
        both, own, other = (rng.integers(0, 2**63, rng.integers(lo, 300), dtype=np.uint64) for lo in (1, 0, 0))
        a, b = np.union1d(both, own), np.union1d(both, other)
        heads = [np.concatenate((np.array([len(x)], np.uint64), jaccard_join.parity(x))) for x in (a, b)]
        linked = 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
        least = int(jaccard_join.bound(85)(*heads))
        assert least <= len(np.setxor1d(a, b)) or not linked


def test_long_sets_are_told_apart_by_their_second_bitmap():
    """Sets of more than 6,000 fill the first bitmap; the second one still drops all unrelated pairs, over different widths, and no linked one."""
    rng = np.random.default_rng(2)
    sizes = [3000, 4096, 5000, 7000, 8000, 8192, 9000, 16000, 16384, 18000, 20000, 33000]
    sets = []
    for n in sizes:
        base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        sets += [base, np.unique(np.concatenate((base[: int(0.93 * n)], rng.integers(0, 2**63, n // 20, dtype=np.uint64)))), np.unique(np.concatenate((base[: n // 2], rng.integers(0, 2**63, n // 2, dtype=np.uint64))))]
    head = np.stack([np.concatenate((np.array([len(x)], np.uint64), jaccard_join.parity(x))) for x in sets])
    heads = jaccard_join.Heads(head, [jaccard_join.parity(x, bits).tobytes() if (bits := jaccard_join.long_bits(len(x))) else None for x in sets], 85)
    every, found, linked = np.arange(len(sets)), [], []
    for i, x in enumerate(sets):
        found += [(i, j) for j in every[heads.near(i, every)].tolist()]
        linked += [(i, j) for j, y in enumerate(sets) if 100 * (both := len(np.intersect1d(x, y, assume_unique=True))) >= 85 * (len(x) + len(y) - both)]
    assert found == linked and len(linked) > len(sets)
    first = jaccard_join.bound(85)
    assert sum(int((first(head[i], head) < jaccard_join._FAR).sum()) for i in every) > len(linked)


def test_long_texts_across_components(spark):
    """Long texts that share passages and miss the threshold, near copies in different stars, against all pairs."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(1500)]
    rows = []
    for k in range(4):
        base = [f"u{rng.randrange(10**7)}" for _ in range((3500, 5200, 7400, 15500)[k])] + passage
        rows.append(base)
        for _ in range(4):
            own = list(base)
            for _ in range(rng.randrange(1, len(own) // 70)):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**7)}"
            rows.append(own)
    rows = list(enumerate(" ".join(x) for x in rows))
    assert found(spark, rows) == plain(rows)


def test_whole_table_in_sql(spark, sf_dir):
    import duckdb

    from sondage.llm.queries import ORACLES, QUERIES

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = c.execute(ORACLES["op12_jaccard_join"])
    names = [x[0] for x in want.description]
    assert sorted(tuple(r) for r in QUERIES["op12_jaccard_join"](spark, sf_dir).select(*names).collect()) == sorted(want.fetchall())
