"""Quality rules, line dedup, byte-level BPE, token counts and token files against plain versions."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from sondage.llm import byte_bpe, line_dedup, quality, token_counts, token_files
from sondage.llm.common import Staging

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, "a", "word " * 300, "x\n\nx\n x \nx", "é ü # $ <|endoftext|> |", "one\x0btwo\x0cthree\r\nfour", " " * 50, "日本語 テキスト " * 9, "don't we'll  they're\t\tA1b2   \n", "a b c d e f g h i " * 4]


def brute_measures(text):
    text = text or ""
    words = WORD.findall(text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, len(covered)


@given(st.text(alphabet="ab \n#é", max_size=120))
@settings(max_examples=200, deadline=None)
def test_measures(text):
    assert quality.measure(text.encode()) == brute_measures(text)


def test_quality(spark):
    rng = random.Random(2)
    rows = [(i, t, "odd") for i, t in enumerate(ODD)]
    rows += [(100 + i, " ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(99)) for _ in range(rng.choice([5, 30, 60]))), rng.choice(["a", "b", None])) for i in range(200)]
    rows += [(900 + i, "too short", "bad") for i in range(50)] + [(990, " ".join(map(str, range(40))), "bad")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert len(got) == len(rows)
    hosts = {}
    failed = {}
    for i, t, s in rows:
        m = brute_measures(t)
        assert tuple(got[i][x] for x in quality.MEASURES) == m
        failed[i] = m[0] < 20 or 100 * m[4] > 30 * m[0]
        assert got[i].base_failed == failed[i]
        hosts.setdefault(s or "", []).append(failed[i])
    rates = {h: sum(f) / len(f) for h, f in hosts.items()}
    mean = sum(rates.values()) / len(rates)
    variance = sum((r - mean) ** 2 for r in rates.values()) / (len(rates) - 1)
    weight = min(max(mean * (1 - mean) / variance - 1, 1.0), 1000.0)
    shrunk = {h: (sum(f) + mean * weight) / (len(f) + weight) for h, f in hosts.items()}
    for i, _, s in rows:
        assert got[i].host_rate == pytest.approx(shrunk[s or ""])
        assert got[i].kept == (not failed[i] and shrunk[s or ""] <= 0.5)
    assert not got[990].base_failed and not got[990].kept
    kept = quality.keep_quality(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality.quality(docs.limit(0)).collect() == [] and quality.keep_quality(docs.limit(0)).collect() == []


def brute_line_groups(docs, percent=90):
    """Links by Levenshtein distance of all pairs of normal forms; nothing of the operator is used."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    forms = {}
    for d, t in docs:
        for k, line in enumerate((t or "").split("\n")):
            if f := " ".join("".join(c if c.isalnum() else " " for c in line.lower()).split()):
                forms.setdefault(f, []).append((d, k))
    names = sorted(forms)
    parent = list(range(len(names)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for j in range(i):
            most = (100 - percent) * max(len(a), len(names[j])) // 100
            if sum((Counter(a) - Counter(names[j])).values()) <= most and distance(a, names[j]) <= most:
                parent[root(i)] = root(j)
    gone = set()
    groups = {}
    for i, n in enumerate(names):
        groups.setdefault(root(i), []).extend(forms[n])
    for places in groups.values():
        gone |= set(places) - {min(places)}
    return gone


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(4)
    base = [" ".join("w%d" % rng.randrange(500) for _ in range(rng.choice([2, 6, 40, 80]))) for _ in range(25)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            words = rng.choice(base).split()
            kind = rng.random()
            if kind < 0.4:
                words[rng.randrange(len(words))] += "s"
            elif kind < 0.5:
                words = ["New%d" % rng.randrange(10**6) for _ in range(8)]
            lines.append(rng.choice(["", "* "]) + " ".join(words).capitalize() + rng.choice(["", ".", " !"]))
        docs.append((d, "\n".join(lines + rng.choice([[], ["", "---"]]))))
    gone = brute_line_groups(docs)
    frame = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, n_lines int").repartition(3)
    got = line_dedup.dedup_lines(frame).collect()
    assert len(got) == len(docs)
    for r in got:
        lines = dict(docs)[r.doc_id].split("\n")
        assert r.text == "\n".join(x for k, x in enumerate(lines) if (r.doc_id, k) not in gone)
        assert r.n_lines == len(lines) and r.n_removed == sum((r.doc_id, k) in gone for k in range(len(lines)))


def test_close_long_lines_are_found(spark):
    """One word changed of 200: all such lines are caught."""
    rng = random.Random(9)
    docs = []
    for d in range(0, 200, 2):
        words = ["w%d" % rng.randrange(10**5) for _ in range(200)]
        docs.append((d, " ".join(words)))
        words[rng.randrange(200)] = "other"
        docs.append((d + 1, " ".join(words)))
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).where("n_removed = 1").collect()
    assert all(r.doc_id % 2 for r in got) and len(got) == 100


def test_line_dedup_edges(spark):
    rows = [(1, None), (2, ""), (3, "same\nSame!\nsame"), (3, "same\nSame!\nsame"), (None, "same"), (5, "\n\n"), (6, "x" * 100_000 + "\nother")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(line_dedup.dedup_lines(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [(r.doc_id, r.text) for r in got] == [(None, "same"), (1, None), (2, ""), (3, ""), (3, ""), (5, "\n\n"), (6, rows[-1][1])]
    assert [r.n_removed for r in got] == [0, 0, 0, 3, 3, 0, 0]
    assert line_dedup.dedup_lines(docs.limit(0)).collect() == []


@pytest.fixture(scope="module")
def plain_bpe():
    with open(public_tokenizers.path(byte_bpe.RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.text(alphabet=st.sampled_from("ab1. \n\t',é日!'s\u00a0"), max_size=200), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_pieces_are_safe(plain_bpe, text, size):
    parts = list(byte_bpe.pieces(text, size))
    assert "".join(parts) == text
    assert [i for x in parts for i in plain_bpe.encode_ordinary(x)] == plain_bpe.encode_ordinary(text)


def test_byte_bpe(spark, plain_bpe):
    texts = [*ODD, "long text, with words. " * 9000, "a" * 120_000, " \n" * 60_000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, "", 1)], "doc_id long, text string, ids int")
    got = byte_bpe.digests(byte_bpe.encoded(docs)).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        ids = plain_bpe.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert byte_bpe.encoded(docs.limit(0)).collect() == []


def brute_count(model, token):
    """Best segmentation by trying all."""
    best = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        size = len(token[end - 1].encode())
        options = [(-(best[end - 1][0] + size * model.byte), best[end - 1][1] + size)]
        options += [(-(best[s][0] + model.score[token[s:end]]), best[s][1] + 1) for s in range(end) if token[s:end] in model.score]
        score, n = min(options)
        best.append((-score, n))
    return best[-1][1]


def test_token_counts(spark, monkeypatch):
    model = token_counts.unigram(public_tokenizers.path(token_counts.MODEL))
    rng = random.Random(6)
    texts = [*ODD, *(" ".join("".join(rng.choice(["th", "e", "an", "ing", "ß", "日", "x", "q"]) for _ in range(rng.randrange(1, 7))) for _ in range(80)) for _ in range(20)), "ab" * 5000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = {i: sum(brute_count(model, "▁" + w) for w in (t or "").encode().decode().split(" ") for w in WORD.findall(w)) for i, t in enumerate(texts)}
    got = token_counts.token_counts(docs).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert {r.doc_id: r.n_pretokens for r in got} == {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    assert token_counts.token_counts(docs.limit(0)).collect() == []
    small = token_counts.Unigram(["▁a", "a", "b", "ab", "▁ab"])
    monkeypatch.setattr(token_counts, "MOST_NODES", 5)
    assert [small.count([w]) for w in ("ab", "aab", "bbbb", "ab", "aab")] == [brute_count(small, "▁" + w) for w in ("ab", "aab", "bbbb", "ab", "aab")]
    assert not math.isnan(small.byte)


def test_token_counts_look_no_further_back_than_pieces_go():
    """A piece of 200 letters makes no search of words without its end longer; words that occur twice in a text and in emptied tries are counted alike."""

    class Looked(dict):
        asked = 0

        def __contains__(self, key):
            Looked.asked += 1
            return super().__contains__(key)

    model = token_counts.Unigram(["ab", "b", "cd" * 100])
    model.ends = Looked(model.ends)
    words = ["ab" * 40, "xyz", "ab" * 40, "cd" * 60]
    assert model.count(words) == sum(brute_count(model, "▁" + w) for w in words)
    assert Looked.asked < 120 * 121 // 2 + 400
    model.clear()
    assert model.count(words) == sum(map(brute_count, [model] * 4, ["▁" + w for w in words]))


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=400))
@settings(max_examples=200, deadline=None)
def test_simple8b_round_trip(ids):
    ids = np.array(ids, np.uint64)
    words = token_files.pack(ids)
    assert (token_files.unpack(words) == ids).all()


def test_simple8b_density():
    assert len(token_files.pack(np.zeros(600, np.uint64))) == 10
    assert len(token_files.pack(np.full(300, 50_000, np.uint64))) == 100
    assert len(token_files.pack(np.full(3, 2**61, np.uint64))) == 6


@pytest.fixture(scope="module")
def plain_tokenizer():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))


@given(st.text(alphabet=st.sampled_from("ab1. \n\t',é日!'s\u00a0\u2003\0_²"), max_size=200))
@settings(max_examples=400, deadline=None)
def test_chunked_encoding(plain_tokenizer, text):
    coder = token_files.encoder(public_tokenizers.path(token_files.TOKENIZER))
    for got, x in zip(coder.encode([x.encode() for x in (text, "", text + ".")]), [text, "", text + "."], strict=True):
        assert got.tolist() == plain_tokenizer.encode(x, add_special_tokens=False).ids


def test_special_tokens_and_patterned_pieces(plain_tokenizer):
    """The library's own ids for special tokens in texts; pieces whose letters follow a pattern that defeats sums of powers stay apart."""
    coder = token_files.Encoder(public_tokenizers.path(token_files.TOKENIZER))
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a  <|endoftext|>  b.<|endoftext|>,c", *("".join(pair[x] for x in bits[:n]) for n in (1024, 4096) for pair in ("ab", "ba"))]
    for got, x in zip(coder.encode([x.encode() for x in texts]), texts, strict=True):
        assert got.tolist() == plain_tokenizer.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("block", [1, 50, 65_536])
def test_token_files(spark, plain_tokenizer, block):
    texts = [*ODD, "long text, with words. " * 3000]
    rows = [(i * 7 % 31, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = f"{Staging(spark, 't').root}/files"
    token_files.write(docs, folder, block_ids=block)
    got = {r.doc_id: r for r in token_files.digests(token_files.read(spark, folder)).collect()}
    start = 0
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = plain_tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(rows)


def test_token_files_edges(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (None, "c")], "doc_id long, text string")
    folder = f"{Staging(spark, 't').root}/files"
    token_files.write(docs, folder)
    got = sorted(token_files.read(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 1, 1] and [r.start for r in got] == [0, 2, 4, 6]
    empty = f"{Staging(spark, 't').root}/files"
    token_files.write(docs.limit(0), empty)
    assert token_files.read(spark, empty).collect() == []
