"""Words, shingles, near-duplicates and decontamination against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from sondage.llm import decontaminate, line_dedup, near_dedup
from sondage.llm.common import Staging
from sondage.llm.linking import connected_components
from sondage.llm.words import shingle_sets, span_hashes


def brute_set(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(rows, percent=75):
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, brute_set(t)) for i, t in rows if i is not None]
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {i: root(i) for i in ids}


def make_texts(rng, n):
    vocabulary = ["w%d" % i for i in range(400)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.5:  # a copy with some words changed
            words = rng.choice(texts).split()
            for _ in range(rng.randrange(0, max(1, len(words) // 12) + 1)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 5, 6, 40, 80, 300]))))
    return texts


def test_shingle_counts():
    texts = ["a b c d e f", "", "One two", "ONE  TWO\n", "x " * 5000, "é ü ñ o p q", "a\x0bb\x0cc\rd\te"]
    for (hashes, words), text in zip(shingle_sets(t.encode() for t in texts), texts, strict=True):
        assert len(hashes) == len(brute_set(text))
        assert words == len(text.split())
    one, two = (h for h, _ in shingle_sets([b"One two", b"ONE  TWO\n"]))
    assert (one == two).all()
    a, b = (h for h, _ in shingle_sets([b"ab c", b"a bc"]))
    assert (a != b).all()


def test_patterned_texts_are_told_apart(spark):
    """Sums of powers modulo 2**64 can't tell the Thue-Morse sequence from its complement."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    words = ["".join(pair[x] for x in bits[:1024]) for pair in ("ab", "ba")]
    texts = [" ".join([w, "one", "two", "three", "four"]) for w in words] + [" ".join(pair[x] for x in bits) for pair in (("foo", "bar"), ("bar", "foo"))]
    assert len({h.tobytes() for h, _ in shingle_sets(t.encode() for t in texts[:2])}) == 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.kept for r in near_dedup.near_duplicates(docs.where("doc_id < 2")).collect()] == [True, True]
    near = line_dedup.Lines([t.encode() for t in texts])
    assert len({x.tobytes() for x in near.digest}) == 4
    items = spark.createDataFrame([(0, texts[0])], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.contaminated(docs.where("doc_id < 2"), items).collect()] == [0]


def test_span_hashes():
    raw = np.frombuffer(b"abcdefghabcdefgh" + b"x" * 600 + b"y", np.uint8)
    start, end = np.array([0, 8, 0, 0, 16, 17, 16, 3, 616]), np.array([8, 16, 16, 0, 616, 617, 615, 3, 617])
    a, b = span_hashes(raw, start, end, (1, 2))
    assert a[0] == a[1] and b[0] == b[1] and a[3] == a[7]
    assert len(set(a.tolist())) == 7 and len(set(b.tolist())) == 7 and not set(a.tolist()) & set(b.tolist())


def test_percent():
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(None, 60)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(50)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), Staging(spark, "t")).collect()
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {r.id: r.component for r in found} == {x: root(x) for x in linked}
    assert len(found) == len(linked)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    rows = list(enumerate(make_texts(rng, 400)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_components(rows)
    got = near_dedup.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(brute_set(t)) for i, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = near_dedup.drop_near_duplicates(docs)
    assert {r.doc_id for r in kept.collect()} == set(want.values())


def test_large_bucket_of_just_dissimilar_texts(spark, monkeypatch):
    """Texts that share a long passage but are mostly below the threshold, in buckets of several blocks."""
    monkeypatch.setattr("sondage.llm.linking.BLOCK", 16)
    rng = random.Random(8)
    passage = " ".join("p%d" % i for i in range(100))
    rows = [(i, passage + " " + " ".join("u%d" % rng.randrange(10**6) for _ in range(rng.choice([25, 30, 34, 38, 60])))) for i in range(90)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 90, 9)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)


def test_near_duplicates_edges(spark):
    long = " ".join("l%d" % i for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE two"), (6, long), (7, long + " x"), (7, long + " x"), (None, "one two"), (9, "one")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, n_shingles int")
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got}
    assert found[1] == (0, 1, True) and found[2] == (0, 2, True) and found[3] == (0, 3, True)
    assert found[4] == (1, 4, True) and found[5] == (1, 4, False) and found[9] == (1, 9, True)
    assert found[6][1:] == (6, True) and found[7][1:] == (6, False)
    assert near_dedup.drop_near_duplicates(docs).columns == docs.columns
    assert near_dedup.near_duplicates(docs.limit(0)).collect() == []


def test_signature_keys_cover_one_error_a_chunk():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 65536, (1, near_dedup.POSITIONS)).astype("<u2")
    b = a.copy()
    for chunk in range(near_dedup.CHUNKS):  # 23 differences: one chunk has a single one
        for at in range(1 if chunk == 5 else 2):
            b[0, chunk * near_dedup.WIDTH + at] ^= 1
    assert near_dedup.distance(a, b)[0] == near_dedup.GUARANTEED
    assert set(near_dedup.signature_keys(a)[0].tolist()) & set(near_dedup.signature_keys(b)[0].tolist())


def brute_contaminated(docs, items, percent=75):
    out = set()
    for d, t in docs:
        held = brute_set(t)
        for i, x in items:
            q = brute_set(x)
            if q and 100 * len(q & held) >= percent * len(q):
                out.add((d, i, len(q & held), len(q)))
    return out


@pytest.mark.parametrize("block", [None, 5])
def test_decontamination_against_brute_force(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", block)
    rng = random.Random(11)
    vocabulary = ["v%d" % i for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 2, 5, 8, 20, 33, 60])))) for i in range(12 if block else 60)]
    docs = []
    for d in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 30, 200, 2000]))]
        if rng.random() < 0.6:
            inside = rng.choice(items)[1].upper().split()
            for _ in range(rng.randrange(3)):
                if inside:
                    inside[rng.randrange(len(inside))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = inside
        docs.append((d, " ".join(words)))
    docs += [(500, items[1][1]), (501, items[3][1] + " "), (502, None)]
    frame = spark.createDataFrame([(d, t, "s") for d, t in docs], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame(items + [(999, None)], "item_id long, text string")
    want = brute_contaminated(docs, items)
    assert {tuple(r) for r in decontaminate.contaminated(frame, benchmark).collect()} == want
    clean = decontaminate.drop_contaminated(frame, benchmark)
    assert clean.columns == frame.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {w[0] for w in want}


def test_decontamination_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, none).collect() == []
    assert decontaminate.drop_contaminated(docs, none).count() == 1
    assert decontaminate.contaminated(docs.limit(0), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).collect() == []
