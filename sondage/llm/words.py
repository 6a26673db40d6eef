"""Words and word shingles of many texts at once, as NumPy arrays inside a task.

A word is a run of bytes other than space and 0x09-0x0D. As UTF-8 uses these bytes for nothing else, the
bytes of a text can be split without being decoded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np

#: Texts are taken in slices of about this many bytes, so that the arrays of a slice stay near 50 MB. One longer text is a slice of its own.
SLICE_BYTES = 1_000_000
SHINGLE = 5

_STEPS = [np.uint64(x | 1) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
#: Spans over so many bytes are hashed one by one, all others eight bytes at a time in arrays.
_LONG_SPAN = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: Iterable[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts) for consecutive slices; null counts as empty."""
    held: list[bytes] = []
    first = size = 0
    for i, x in enumerate(texts):
        x = x or b""
        if held and size + len(x) > SLICE_BYTES:
            yield first, held
            held, first, size = [], i, 0
        held.append(x)
        size += len(x) + 1
    if held:
        yield first, held


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seeds: tuple[int, ...] = (0,)) -> list[np.ndarray]:
    """A hash of the bytes of each span for each seed.

    Eight bytes at a time are taken up by a bijection after which every bit depends on all before, so spans of up to eight bytes and equal
    length never share a hash, and no pattern in longer ones (as there is for sums of powers) makes them share one.
    """
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    size = (end - start).astype(np.int64)
    out = [mix(size.astype(np.uint64) * _STEPS[0] ^ np.uint64(seed)) for seed in seeds]
    left = np.flatnonzero((size > 0) & (size <= _LONG_SPAN))
    at = 0
    while len(left):
        rest = size[left] - at
        part = eight[start[left] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * np.maximum(8 - rest, 0).astype(np.uint64)))
        for x, step in zip(out, _STEPS[1:]):
            x[left] = mix((x[left] ^ part) * step)
        at += 8
        left = left[rest > 8]
    for i in np.flatnonzero(size > _LONG_SPAN).tolist():
        digest = hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8 * len(seeds)).digest()
        for k, x in enumerate(out):
            x[i] = int.from_bytes(digest[8 * k : 8 * k + 8], "little")
    return out


class Numbers:
    """Numbers of 64-bit hashes in order of insertion: an open hash table whose look-ups are array operations."""

    def __init__(self, bits: int = 12) -> None:
        self.count, self.mask = 0, np.uint64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for those not inserted; 0 is no hash."""
        at = (hashes & self.mask).astype(np.int64)
        held = self.keys[at]
        out = np.where(held == hashes, self.values[at], -1)
        left = np.flatnonzero((held != hashes) & (held != 0))
        while len(left):
            at[left] = (at[left] + 1) & int(self.mask)
            held = self.keys[at[left]]
            same = held == hashes[left]
            out[left[same]] = self.values[at[left[same]]]
            left = left[~same & (held != 0)]
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Inserts distinct hashes that aren't there yet."""
        while 2 * (self.count + len(hashes)) > len(self.keys):
            keys, values = self.keys, self.values
            self.keys, self.values = np.zeros(2 * len(keys), np.uint64), np.zeros(2 * len(keys), np.int32)
            self.mask = np.uint64(len(self.keys) - 1)
            self._put(keys[keys != 0], values[keys != 0])
        self._put(hashes, np.arange(self.count, self.count + len(hashes), dtype=np.int32))
        self.count += len(hashes)

    def _put(self, hashes: np.ndarray, values: np.ndarray) -> None:
        at = (hashes & self.mask).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = hashes[free]  # of several for one place, one stays
            won = self.keys[at[left]] == hashes[left]
            self.values[at[left[won]]] = values[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & int(self.mask)


class Words:
    """All words of a slice: ``hash`` by word, and text ``i`` has words ``at[i]`` to ``at[i + 1]``."""

    def __init__(self, texts: list[bytes], lower: bool = False) -> None:
        joined = b"\n".join(texts) + b"\n"
        self.joined = joined.lower() if lower else joined
        self.raw = np.frombuffer(self.joined, np.uint8)
        space = (self.raw == 32) | ((self.raw >= 9) & (self.raw <= 13))
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
        self.start, self.end = edge[0::2], edge[1::2]
        ends = np.cumsum([len(x) + 1 for x in texts])
        self.at = np.concatenate(([0], np.searchsorted(self.start, ends)))
        self.hash = span_hashes(self.raw, self.start, self.end)[0]

    def shingles(self, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, at): the hash of the ``width`` words (five at most) from each word on, where the text has so many; a shorter text's words are one shingle.

        ``hashes[at[i]:at[i + 1]]`` are those of text ``i``, in order of position, with repeats.
        """
        n = np.diff(self.at)
        total = len(self.hash)
        summed = np.zeros(max(total - width + 1, 0), np.uint64)
        for j, step in enumerate(_STEPS[:width]):
            summed += self.hash[j : total - width + 1 + j] * step
        count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
        at = np.concatenate(([0], np.cumsum(count)))
        out = np.empty(at[-1], np.uint64)
        long = n >= width
        if long.any():
            size = count[long]
            put = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(at[:-1][long], size) + put] = mix(summed[np.repeat(self.at[:-1][long], size) + put])
        for i in np.flatnonzero((n > 0) & ~long):
            own = self.hash[self.at[i] : self.at[i + 1]]
            out[at[i]] = mix(mix(np.sum(own * np.array(_STEPS[: len(own)]), dtype=np.uint64, keepdims=True)) + np.uint64(len(own)))[0]
        return out, at


def shingle_sets(texts: Iterable[bytes | None], lower: bool = True, width: int = SHINGLE) -> Iterator[tuple[np.ndarray, int]]:
    """(sorted distinct shingle hashes, count of words) of each text, in order."""
    for _, held in slices(texts):
        words = Words(held, lower)
        hashes, at = words.shingles(width)
        n = np.diff(words.at)
        for i in range(len(held)):
            yield np.unique(hashes[at[i] : at[i + 1]]), int(n[i])
