"""What the search for near lines sends and compares, besides its results."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from sondage.llm import line_dedup, linking


def close_lines(rng, n, share):
    """A line of ``n`` letters, and the same with a share of the letters changed all over."""
    line = "".join(rng.choice("abcdefgh ") for _ in range(n))
    return line.encode(), "".join(rng.choice("xyz") if rng.random() < share else c for c in line).encode()


def test_pairs_of_different_lengths_are_measured_at_once(monkeypatch):
    """Pairs just below and above the limit, of 200 to 900 letters: hardly any is measured by itself."""
    rng, alone = random.Random(3), []
    banded = line_dedup._banded
    monkeypatch.setattr(line_dedup, "_banded", lambda a, b, most: alone.append(1) or banded(a, b, most))
    pairs = [close_lines(rng, rng.randrange(200, 900), rng.choice([0.05, 0.09, 0.11, 0.14])) for _ in range(200)]
    got = line_dedup.Forms([x for pair in zip(*pairs, strict=True) for x in pair], 90).near(np.arange(200), np.arange(200, 400))
    assert len(alone) <= 20
    assert got.tolist() == [line_dedup.similar(a, b, 90) for a, b in pairs] and 50 < got.sum() < 150


def test_bands_of_several_words():
    """Distances of pairs with up to a fifth of the letters changed, left out and put in, for bands of one to several machine words."""
    rng = random.Random(4)
    for size in (3, 63, 64, 65, 130, 320, 700, 1500):
        a, b = [], []
        for _ in range(20):
            line = "".join(rng.choice("abcd ") for _ in range(size))
            other = "".join(rng.choice(["", c + "x", "y"]) if rng.random() < 0.15 else c for c in line) or "z"
            a.append(line.encode())
            b.append(other.encode())
        forms, first = line_dedup.Forms(a + b, 80), np.arange(20)
        most = np.maximum(forms.size[first], forms.size[first + 20]) // 5
        first = first[np.abs(forms.size[first] - forms.size[first + 20]) <= most]
        for words, own in forms._groups(most[first], forms.size[first], forms.size[first + 20]):
            x = first[own]
            got = forms._distances(forms.start[x], forms.size[x], forms.start[x + 20], forms.size[x + 20], most[x], words)
            assert np.minimum(got, most[x] + 1).tolist() == [min(line_dedup.edit_distance(a[i], b[i], int(most[i])), int(most[i]) + 1) for i in x.tolist()]


def test_shared_keys(spark, monkeypatch):
    """Only keys of different lines leave the tasks, once for each line, however little of a range is held at a time."""
    rng = random.Random(5)
    lines = [(rng.randrange(-400, 400), rng.randrange(2**63)) for _ in range(800)]
    keys = {i: [rng.randrange(2**64) for _ in range(5)] + [rng.choice([7, 2**63 + 9, 2**64 - 1]) for _ in range(i % 40 == 0)] + [2**60 + i // 2] for i, _ in lines}
    rows = spark.createDataFrame([(i, bytearray(np.array([x, 9, *keys[i]], "<u8").tobytes())) for i, x in lines], "id long, sig binary").repartition(7)
    met = defaultdict(set)
    for i in keys:
        for k in keys[i]:
            met[k].add(i)
    wanted = sorted((k, i) for k, ids in met.items() if len(ids) > 1 for i in ids)
    for most in (1 << 19, 60):
        monkeypatch.setattr(line_dedup, "RANGE_KEYS", most)
        assert sorted((r.key % 2**64, r.id) for r in line_dedup.shared_keys(rows).collect()) == wanted
    held = line_dedup.Shared(50)
    sent = np.array([(k % 2**64, i % 2**64) for i in keys for k in keys[i]], np.uint64)
    out = [x for at in range(0, len(sent), 20) if (x := held.add(sent[at : at + 20])) is not None] + [held.found()]
    signed = [(int(k), int(np.uint64(i).view(np.int64))) for k, i in np.concatenate(out).tolist()]
    assert sorted(set(signed)) == wanted
    assert line_dedup.shared_keys(rows.limit(0)).collect() == []


def test_blocks_are_compared_together(spark):
    """Tests of many blocks are made in few calls, and the links are those of all pairs of a block."""
    rng, n = random.Random(6), 60
    members = [(key, rng.randrange(5000) * n + key) for key in range(n) for _ in range(rng.randrange(2, 9))]
    asked = []

    def alike(held):
        asked.append(len(held))
        values = np.array([int(x.to_pybytes()) for x in held])
        return lambda a, b: np.abs(values[a] - values[b]) < 60_000

    groups = defaultdict(list)
    for key, i in members:
        groups[key].append(i)
    tables = [pa.table({"key": [key] * len(ids), "i": [0] * len(ids), "j": [0] * len(ids), "own": [0] * len(ids), "id": ids, "component": ids, "held": [str(i).encode() for i in ids]}) for key, ids in groups.items()]
    found = [x for x in linking.linked(iter(tables), lambda x: ((i, np.arange(i + 1, x.num_rows)) for i in range(x.num_rows - 1)), alike, 4, 1 << 20) if x]
    assert len(asked) < n / 2
    parent = {i: i for _, i in members}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for x in found:
        for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), strict=True):
            assert abs(a - b) < 60_000 and root(a) != root(b)
            parent[root(a)] = root(b)
    for ids in groups.values():
        assert all(root(a) == root(b) for a in ids for b in ids if abs(a - b) < 60_000)
