"""Recall of line dedup by length of line, against all pairs by Levenshtein distance alone, with a normal form of its own."""

from __future__ import annotations

import random
import string
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from sondage.llm import line_dedup

#: Words of a line, and the least share of near lines found; the measured shares are in the README.
LENGTHS, RECALL = (5, 10, 20, 40, 80, 200), 0.9


def plain_normal(line):
    return " ".join("".join(c if c.isalnum() else " " for c in line.lower()).split())


def plain_distance(a, b, most):
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def near(a, b):
    a, b = plain_normal(a), plain_normal(b)
    most = max(len(a), len(b)) // 10
    if sum((Counter(a) - Counter(b)).values()) > most:  # so many letters have to go at least
        return False
    return plain_distance(a, b, most) <= most


def word(rng, size=None):
    return "".join(rng.choice(string.ascii_lowercase) for _ in range(size or rng.randrange(2, 10)))


def near_lines(n, pairs, seed=5):
    """Pairs of lines of ``n`` words that differ in one word of at most a tenth of the characters, so that they are near for certain."""
    rng = random.Random(seed)
    out = []
    while len(out) < pairs:
        words = [word(rng) for _ in range(n)]
        other = list(words)
        at = rng.randrange(n)
        other[at] = word(rng, len(other[at]))
        if other != words and len(other[at]) <= len(" ".join(words)) // 10:
            out.append((" ".join(words), " ".join(other)))
    return out


def one_letter(n, pairs, seed=6):
    rng = random.Random(seed)
    out = []
    for _ in range(pairs):
        words = [word(rng) for _ in range(n)]
        other = list(words)
        at = rng.randrange(n)
        other[at] = other[at][:-1] + rng.choice("0123456789")
        out.append((" ".join(words), " ".join(other)))
    return out


@pytest.mark.parametrize("make", [near_lines, one_letter])
def test_against_all_pairs(spark, make):
    """What goes is near a line before it by Levenshtein alone, of all pairs; of what should go, nine in ten do at least, for each length."""
    lines = {n: make(n, 15, seed=n) for n in LENGTHS if n > 5 or make is one_letter}
    rows = [x for pairs in lines.values() for pair in pairs for x in pair]
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).where("n_removed = 1").collect()
    gone = {r.doc_id for r in got}
    wanted = {j for j in range(len(rows)) if any(near(rows[i], rows[j]) for i in range(j))}
    assert gone <= wanted
    at = 0
    for pairs in lines.values():
        ids = set(range(at, at + 2 * len(pairs)))
        at += 2 * len(pairs)
        assert len(gone & ids) >= RECALL * len(wanted & ids)


def test_lines_of_the_documents():
    """Of the near lines among the documents of the test tables, by all pairs, nine in ten share a key at least."""
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist()
    forms = sorted({f for t in table for line in (t or "").split("\n") if (f := plain_normal(line))}, key=len)
    counts = np.array([np.bincount([ord(c) % 64 for c in f], minlength=64) for f in forms])
    sizes = np.array([len(f) for f in forms])
    keys = [set(line_dedup.block_keys(x).tolist()) for x in line_dedup.Lines(["\n".join(forms).encode()]).sig.to_pylist()]
    met = []
    for j in range(len(forms)):
        others = np.flatnonzero((sizes[:j] >= sizes[j] - sizes[j] // 10) & (np.abs(counts[:j] - counts[j]).sum(axis=1) <= 2 * (sizes[j] // 10)))
        met += [bool(keys[i] & keys[j]) for i in others.tolist() if near(forms[i], forms[j])]
    assert len(met) > 10 and sum(met) >= RECALL * len(met)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(1, 90)))
        b = "".join(c if rng.random() > 0.15 else rng.choice("abé日") for c in a) + rng.choice(["", "a", "ab"])
        most = max(len(a), len(b)) // 5
        assert min(line_dedup.edit_distance(a.encode(), b.encode(), most), most + 1) == min(plain_distance(a, b, most), most + 1)


def test_pairs_at_once(monkeypatch):
    """Forms of one to several machine words, all pairs, against plain distances."""
    monkeypatch.setattr(line_dedup.Forms, "AT_ONCE", 700)
    rng = random.Random(2)
    forms = []
    for n in (1, 9, 10, 30, 63, 64, 65, 128, 130, 200, 400):
        base = "".join(rng.choice("abcdé 日") for _ in range(n))
        forms += [base, *("".join(rng.choice(["", "x", c + "y"]) if rng.random() < share else c for c in base) or "z" for share in (0.03, 0.05, 0.08, 0.1, 0.13))]
    a, b = np.array([(i, j) for i in range(len(forms)) for j in range(len(forms)) if abs(len(forms[i]) - len(forms[j])) < 40]).T
    got = line_dedup.Forms([x.encode() for x in forms], 90).near(a, b)
    for i, j, found in zip(a.tolist(), b.tolist(), got.tolist(), strict=True):
        most = max(len(forms[i]), len(forms[j])) // 10
        assert found == (plain_distance(forms[i], forms[j], most) <= most)
    assert got.sum() > 2 * len(forms)


def test_percent():
    with pytest.raises(ValueError):
        line_dedup.duplicate_lines(None, 80)


def test_normal_form_and_characters(spark):
    """Other alphabets are lower-cased, other punctuation is no part of a line, and distance counts characters."""
    for line in ["ÉTÉ – «été»", "Ärger… 1²", "ΑΣ_Σ", "İx y", "日本語、テキスト。", "snake_case\x1cK"]:
        assert line_dedup.normal(line) == plain_normal(line)
    assert line_dedup.edit_distance("été".encode(), b"ete", 9) == 2 and line_dedup.similar(("é" + "x" * 9).encode(), b"ex" + b"x" * 8, 90)
    docs = spark.createDataFrame([(1, "L’ÉTÉ – à Orléans"), (2, "l'été à orléans!")], "doc_id long, text string")
    assert [r.n_removed for r in line_dedup.dedup_lines(docs).orderBy("doc_id").collect()] == [0, 1]


def test_most_edits_is_a_bound():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 6)))
    for _ in range(2000):
        a = [word() for _ in range(rng.randint(1, 12))]
        b = [word() if rng.random() < 0.15 else x for x in a if rng.random() > 0.1] or ["b"]
        if rng.random() < 0.5:
            b.insert(rng.randrange(len(b) + 1), word())
        x, y = " ".join(a).encode(), " ".join(b).encode()
        assert line_dedup.edit_distance(x, y, 1000) <= line_dedup.most_edits(a, b)
        assert line_dedup.Forms([x, y], 90).near(np.array([0]), np.array([1]))[0] == line_dedup.similar(x, y, 90)
