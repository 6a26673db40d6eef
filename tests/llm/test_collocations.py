"""Collocations against a plain count of all phrases, on defined cases and in DuckDB."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from sondage.llm import collocations

SCHEMA = "text string, lang string, rank string, phrase string"


def plain(rows, fewest, longest, most):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {x for x, c in f.items() if c >= fewest and len(x[1]) > 1}

    def inside(short, long):
        return any(long[i : i + len(short)] == short for i in range(len(long) - len(short) + 1))

    found = {}
    for lang, p in candidates:
        a = f[lang, p]
        if any(o[0] == lang and len(o[1]) > len(p) and inside(p, o[1]) and 100 * f[o] >= 50 * a for o in candidates):
            continue
        score, _, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for lang, rows in found.items() for i, (score, a, p, left, right) in enumerate(sorted(rows)[:most]))


def rows_of(found):
    return sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(count):
    rng = random.Random(5)
    words = ["der", "Die", "das", "été", "ÉTÉ", "x", "new", "york", "city", "a-b", "naïve b", "𝒳"]
    marks = [" ", " ", " ", "  ", "\t", ", ", "\n", "\x0b", "? "]
    out = [("".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "de", None, "und"])) for _ in range(count)]
    return [*out, ("", "en"), (None, "fr"), ("new york city " * 5000, "en"), (" \t ", "de"), ("one two\nthree", "xx"), *[("Same row here", "yy")] * 11]


@pytest.mark.parametrize(("fewest", "longest", "most"), [(10, 3, 2000), (3, 4, 7), (10, 2, 5)])
def test_against_plain_counts(spark, fewest, longest, most):
    rows = texts(150)
    docs = spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA).repartition(3)
    assert rows_of(collocations.collocations(docs, fewest, longest, most)) == plain(rows, fewest, longest, most)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BROADCAST_IDS", 0)
    rows = texts(60)
    assert rows_of(collocations.collocations(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA))) == plain(rows, 10, 3, 2000)


def test_small_holds_and_ties(spark, monkeypatch):
    """Rows handed on in many parts give the same counts; equal scores and counts are in byte order."""
    monkeypatch.setattr(collocations, "HELD", 64)
    monkeypatch.setattr(collocations, "MOST_NAMES", 5)
    rows = [(f"{a} {b}.", "en") for a, b in [("b", "c"), ("B", "ä"), ("é", "a"), ("z", "z")] for _ in range(12)]
    found = rows_of(collocations.collocations(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)))
    assert found == plain(rows, 10, 3, 2000)
    assert [r[2] for r in found] == ["é a", "b c", "b ä", "z z"]


def test_phrases_of_one_hash_are_told_apart():
    """What shares a hash with a known phrase is counted by its text."""
    langs = np.array([7], np.uint64)
    a, b = (collocations.Phrases([x], langs) for x in (b"aa aa bb", b"cc"))
    b.words[0][:] = a.words[0][0]
    counts = collocations.Counts(np.unique(a.words[0]))
    for x in (a, b, a):
        counts.add(x, ["en"], 1)
    assert sorted(counts.rows()) == [("en", "", 0, 7), ("en", "aa", 1, 4), ("en", "bb", 1, 2), ("en", "cc", 1, 1)]
    assert list(counts.rows()) == []


def test_products_past_64_bits(spark, monkeypatch):
    """A phrase as frequent as its parts scores a million, however frequent."""
    big = 3_000_000_000_000
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "a b", 2, big - 1), ("en", "", 0, 2 * big)], "lang string, phrase string, k int, n long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *x: counts)
    row = collocations.collocations(spark.createDataFrame([], SCHEMA)).first()
    assert row.score == 10**6 * (big - 1) ** 2 // (big * (big + 1)) == 999_999


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_word_is_no_phrase(spark):
    with pytest.raises(ValueError, match="two words"):
        collocations.collocations(spark.createDataFrame([], SCHEMA), longest=1)


def test_whole_table_in_sql(spark, sf_dir):
    import duckdb

    from sondage.llm.queries import ORACLES, QUERIES

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = c.execute(ORACLES["op13_phrase_collocations"])
    names = [x[0] for x in want.description]
    assert sorted(tuple(r) for r in QUERIES["op13_phrase_collocations"](spark, sf_dir).select(*names).collect()) == sorted(want.fetchall())


def test_hashes_are_sent_packed(spark):
    """Some 40,000 different phrases are a few rows of the shuffle; the hashes found are those of the frequent phrases."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 3000, 120)) + ", the same end" for _ in range(150)]
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").repartition(3)
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))

    docs = docs.localCheckpoint()
    before = shuffled()
    hashes, shift = collocations.frequent_hashes(docs, 10, 3)
    found = {r.hash for r in hashes.collect()}
    assert shuffled() - before < 1000
    phrases = collocations.Phrases([t.encode() for t in texts], np.full(len(texts), int.from_bytes(hashlib.blake2b(b"en", digest_size=8).digest(), "little"), np.uint64))
    every = np.concatenate([phrases.hashes(k, phrases.places(k)) for k in (1, 2, 3)]) >> np.uint64(shift)
    own, n = np.unique(every, return_counts=True)
    assert found == set(own[n >= 10].tolist()) and len(own) > 30_000


def test_many_frequent_phrases_of_few_words(spark, monkeypatch):
    """Frequent phrases past the limit of a broadcast are still counted by numbers of words: their texts aren't shuffled."""
    monkeypatch.setattr(collocations, "BROADCAST_IDS", 100)
    rng = np.random.default_rng(6)
    rows = [(" ".join(f"w{i}" for i in rng.integers(0, 40, 120)), "en") for _ in range(200)]
    docs = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA).repartition(3).localCheckpoint()
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))

    before = shuffled()
    counts = collocations.phrase_counts(docs)
    assert counts.where("k > 1").count() > 500
    assert shuffled() - before < 1000
    assert rows_of(collocations.collocations(docs)) == plain(rows, 10, 3, 2000)


@pytest.mark.parametrize(("name", "value"), [("KEY_BITS", 0), ("BROADCAST_IDS", 14), ("BROADCAST_IDS", 11)])
def test_phrases_that_numbers_do_not_fit(spark, monkeypatch, name, value):
    """By hash where integers are too short; languages in passes of their own, or by text, where their words are too many."""
    monkeypatch.setattr(collocations, name, value)
    rows = texts(100)
    docs = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA).repartition(3)
    assert rows_of(collocations.collocations(docs)) == plain(rows, 10, 3, 2000)


def test_languages_are_sent_together(monkeypatch):
    monkeypatch.setattr(collocations, "BROADCAST_IDS", 10)
    assert collocations._together([("a", 4), ("b", 6), ("c", 11), ("d", 3), ("e", 7), ("f", 1)]) == [["a", "b"], ["c"], ["d", "e"], ["f"]]
    assert collocations._together([]) == []
