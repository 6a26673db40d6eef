"""Fuzzy line deduplication: SimHash of normalised lines, pigeonhole blocks, edit similarity, one line kept per group.

A line is what ``\\n`` separates. Its normal form is lower case with every run of characters that are neither letters nor digits as
one space; lines with an empty normal form are never duplicates. Equal normal forms are collapsed first.

The SimHash of a line is made in blocks, and each block takes the votes of its own share of the words, dealt by a hash of the word. A
changed word changes two blocks at most, wherever it stands, so by pigeonhole two lines that differ in fewer than half as many words as
there are blocks agree in a block. (Blocks over all the words would nearly all change with a single word of a short line.) Lines have 6 to 24
blocks by their length; a line whose length is within a tenth of the next class has the blocks of both. A block with few letters is read together with
those after it. In lines of fewer than ``SHORT`` characters each word is a block, and the errors are enumerated: such lines meet where they agree
in all words but one. Below ``TINY`` characters only one edit is allowed, and the blocks are the two halves of the characters. All pairs that share a block are verified: their Levenshtein distance may be 10 in 100 of the longer
one's characters. Lines that differ by a letter in most of their words don't meet.
Of each connected group the first occurrence by (doc_id, line number) stays; all other lines of the group are removed.

Defined cases: null text stays null and has no lines; rows that share doc_id and text are one document; a null doc_id
comes before all others; repeated lines inside a document are duplicates as well; extra columns are carried along;
an empty table gives an empty result. ``doc_id`` is an integer.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from functools import cache
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm.common import BROADCAST_IDS, Staging, keep_ids, small_batches, spread_join
from sondage.llm.linking import Distance, link, links_across
from sondage.llm.words import mix, slices, span_hashes

#: Lines of fewer characters have two halves as blocks, or a block for each word.
TINY, SHORT = 20, 64
#: Blocks of lines of ``SHORT`` characters and more, and of twice, four, eight and 16 times as many and more.
BLOCKS = (6, 8, 9, 12, 24)
#: Bytes of words that a block of a longer and of a short line needs.
BLOCK_BYTES, LEFT_BYTES = 12, 8
#: Pairs of a block that are compared before what they link is left out of the next ones.
PAIRS_AT_ONCE = 32
#: About how many keys a range of keys holds.
RANGE_KEYS = 1 << 19
#: Bytes of buckets whose pairs are compared at once.
TOGETHER = 8 << 20
#: Least edit similarity, in percent, that the blocks are made for.
PERCENT = 90

_LANES = np.random.default_rng(20240608).integers(0, 2**63, 3, dtype=np.uint64)
#: Each byte's bits as the eight bytes of an integer, so that one addition counts eight bits.
_BITS_AS_BYTES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view("<u8").ravel()
#: Binary digits of the counts of votes that are taken for all bits at once.
_PLANES = 5
_NORMAL = bytes(c if c == 10 or 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_NO_ID = -(2**63)


@cache
def _stays() -> np.ndarray:
    """By character number: whether it is ASCII, which ``_NORMAL`` sees to, a letter, a digit or ``_``."""
    return np.array([i < 128 or chr(i).isalnum() for i in range(sys.maxunicode + 1)])


def _spaced(text: bytes) -> bytes:
    """The text in lower case, each character but letters, digits and line ends as spaces."""
    if not text.isascii():
        letters = np.frombuffer(text.decode(errors="replace").lower().encode("utf-32-le"), "<u4")
        text = np.where(_stays()[letters], letters, np.uint32(32)).astype("<u4").tobytes().decode("utf-32-le").encode()
    return text.translate(_NORMAL)


def normal(line: str) -> str:
    return b" ".join(_spaced(line.encode()).split()).decode()


class Lines:
    """The lines with a normal form of a slice of texts: text, line number, 128-bit hash, and signature.

    A signature holds 64-bit integers: the parities of the words by six bits of their hashes, the count of characters, and a key for each block.
    """

    def __init__(self, texts: list[bytes]) -> None:
        spaced = [_spaced(x) for x in texts]
        raw = np.frombuffer(b"\n".join(spaced) + b"\n", np.uint8)
        ends, space = np.flatnonzero(raw == 10), raw <= 32
        start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        if len(raw) and not space[0]:
            start = np.append(0, start)
        at = np.searchsorted(start, ends)
        filled = np.flatnonzero(np.diff(at, prepend=0))
        text_ends = np.cumsum([len(x) + 1 for x in spaced]) - 1
        self.text = np.searchsorted(text_ends, ends[filled])
        self.pos = filled - np.append(0, np.searchsorted(ends, text_ends) + 1)[self.text]
        # One space stays before each word but the first of a line, and the ends of the lines that have words.
        stays = ~space
        stays[np.delete(start, np.append(0, at)[filled]) - 1] = True
        stays[ends[filled]] = True
        raw = raw[stays]
        forms = raw.tobytes().split(b"\n")[:-1]
        self.digest = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in forms), "<i8").reshape(-1, 2)
        if forms:
            # Bytes that begin a character, but for the line's end.
            first = np.cumsum([0] + [len(x) + 1 for x in forms[:-1]])
            self.size = np.add.reduceat((raw & 0xC0) != 0x80, first, dtype=np.int64) - 1
            self._sign(raw, forms)
        else:
            self.size, self.sig = np.empty(0, np.int64), pa.array([], pa.binary())

    def _sign(self, raw: np.ndarray, forms: list[bytes]) -> None:
        end = np.flatnonzero(raw <= 32)
        start = np.append(0, end[:-1] + 1)
        hashes, size = span_hashes(raw, start, end)[0], end - start
        at = np.append(0, np.flatnonzero(raw[end] == 10) + 1)
        count = np.diff(at)
        line = np.repeat(np.arange(len(count)), count)
        left_out = self._left_out(hashes, at[:-1], line, size)
        # Each word votes once a line, or else the shares of long lines would hang on the commonest words.
        order = np.argsort(line.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
        hashes, line, size = hashes[order], line[order], size[order]
        fresh = np.append(True, (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1]))
        hashes, line, size = hashes[fresh], line[fresh], size[fresh]
        count = np.bincount(line)
        parity = np.bitwise_xor.reduceat(np.uint64(1) << (hashes >> np.uint64(58)), np.cumsum(count) - count)
        owner, keys = [np.arange(len(count))] * 2, [parity, self.size.astype(np.uint64)]
        for own, found in (self._halves(forms), left_out, *(self._shares(hashes, line, size, k) for k in range(1, len(BLOCKS) + 1))):
            owner.append(own)
            keys.append(found)
        owner, keys = np.concatenate(owner), np.concatenate(keys)
        keys = keys[np.argsort(owner, kind="stable")].astype("<u8")
        ends = np.concatenate(([0], 8 * np.cumsum(np.bincount(owner, minlength=len(count))))).astype(np.int32)
        self.sig = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(ends), pa.py_buffer(keys)])

    def _of_class(self, k: int) -> np.ndarray:
        """Lines of class ``k`` of length, and those of the class below whose partners may be in it."""
        low = SHORT << (k - 1) if k else TINY
        high = SHORT << k if k < len(BLOCKS) else np.inf
        return (100 * self.size >= PERCENT * low) & (self.size < high)

    def _halves(self, forms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The keys of the halves of tiny lines, by the length of the shorter line of a pair. A pair of fewer than ten characters has no edit to spare."""
        owner, keys = [], []
        for i in np.flatnonzero((self.size >= 9) & (self.size < TINY)).tolist():
            letters = forms[i].decode()
            for shorter in (len(letters), len(letters) - 1):
                for side, half in ((0, letters[: shorter // 2]), (1, letters[-(shorter - shorter // 2) :])):
                    owner.append(i)
                    keys.append(int.from_bytes(hashlib.blake2b(f"{shorter} {side} {half}".encode(), digest_size=8).digest(), "little"))
        return np.array(owner, np.int64), np.array(keys, np.uint64)

    def _left_out(self, hashes: np.ndarray, at: np.ndarray, line: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys of short lines: all words, and all but one."""
        short = self._of_class(0)
        vote = mix(hashes ^ _LANES[1])
        total = np.add.reduceat(vote, at)
        length = np.add.reduceat(size, at)
        take = np.flatnonzero(short[line] & (length[line] - size >= LEFT_BYTES))
        owner = np.concatenate([np.flatnonzero(short), line[take]])
        keys = mix(np.concatenate([total[short], total[line[take]] - vote[take]]) ^ _LANES[2])
        order = np.lexsort((keys, owner))
        owner, keys = owner[order], keys[order]
        fresh = np.append(True, (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1]))[: len(owner)]
        return owner[fresh], keys[fresh]

    def _shares(self, hashes: np.ndarray, line: np.ndarray, size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The keys of the lines of a class: the SimHash of each share of the words, with the next ones where it has few letters."""
        own, blocks = self._of_class(k), BLOCKS[k - 1]
        if not own.any():
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        take = np.flatnonzero(own[line])
        at = (np.cumsum(own) - 1)[line[take]] * blocks + ((hashes[take] >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
        # The words of a line are in order of their hashes, so its shares are too.
        first = np.flatnonzero(np.diff(at, prepend=-1))
        count = np.diff(first, append=len(at))
        share, length = np.zeros(own.sum() * blocks, np.uint64), np.zeros(own.sum() * blocks, np.int64)
        share[at[first]] = _simhash(hashes[take], first, count, _LANES[1])
        length[at[first]] = np.add.reduceat(size[take], first)
        share, length = share.reshape(-1, blocks), length.reshape(-1, blocks)
        keys = mix(share ^ mix(np.arange(blocks, dtype=np.uint64) + np.uint64(64 * k)))
        sparse = np.flatnonzero((length < BLOCK_BYTES).any(axis=1))
        share, length, joined = share[sparse], length[sparse], keys[sparse]
        held = length.copy()
        for step in range(1, blocks):
            few = held < BLOCK_BYTES
            if not few.any():
                break
            joined = np.where(few, mix(joined + np.roll(share, -step, axis=1) * _LANES[2]), joined)
            held += np.where(few, np.roll(length, -step, axis=1), 0)
        keys[sparse] = joined
        return np.repeat(np.flatnonzero(own), blocks), keys.ravel()


def _simhash(hashes: np.ndarray, first: np.ndarray, count: np.ndarray, lane: np.uint64) -> np.ndarray:
    """64 bits by majority of the words ``first[i]`` to ``first[i] + count[i]``."""
    votes, out = mix(hashes ^ lane), np.empty(len(first), np.uint64)
    few = count < 1 << _PLANES
    out[few] = _majority(votes, first[few], count[few])
    if not few.all():
        out[~few] = _majority_of_many(votes.view(np.uint8).reshape(-1, 8), first[~few], count[~few])
    return out


def _majority(votes: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The bits that more than half of the votes have, where they are less than 2 ** ``_PLANES``: all bits of a vote are counted at once, in binary numbers whose digits are the bits of ``planes``."""
    order = np.argsort(-count.astype(np.int8), kind="stable")
    first, count = first[order], count[order]
    planes = np.zeros((_PLANES, len(first)), np.uint64)
    for r, k in enumerate(np.searchsorted(-count, -np.arange(int(count[0]) if len(count) else 0), "left").tolist()):
        carry = votes[first[:k] + r]
        for plane in planes[: (r + 1).bit_length(), :k]:
            plane ^= carry
            carry &= ~plane
    # Less than half: where count // 2 + 1 can't be taken away without a borrow.
    borrow = np.zeros(len(first), np.uint64)
    for i, plane in enumerate(planes):
        wanted = -((count // 2 + 1) >> i & 1).astype(np.uint64)
        borrow = (~plane & wanted) | (~(plane ^ wanted) & borrow)
    out = np.empty(len(first), np.uint64)
    out[order] = ~borrow
    return out


def _majority_of_many(raw: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    # A byte counts up to 255 words: longer lines are added up in parts.
    parts = -(-count // 255)
    last = np.cumsum(parts)
    size = np.minimum(255, np.repeat(count, parts) - 255 * (np.arange(last[-1]) - np.repeat(last - parts, parts)))
    start = np.repeat(first, parts) + 255 * (np.arange(last[-1]) - np.repeat(last - parts, parts))
    raw = raw[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]
    start = np.cumsum(size) - size
    out = np.empty((len(first), 64), bool)
    for k in range(8):
        ones = np.add.reduceat(_BITS_AS_BYTES[raw[:, k]], start).view(np.uint8).reshape(-1, 8)
        if len(start) > len(first):
            ones = np.add.reduceat(ones, last - parts, axis=0, dtype=np.int64)
        out[:, 8 * k : 8 * k + 8] = 2 * ones.astype(np.int64) > count[:, None]
    return np.packbits(out, axis=1).view("<u8").ravel()


def distance(percent: int) -> Distance:
    """Bits that differ of the parities of the words; over 64 for lines whose lengths are too far apart for the edit similarity."""

    def bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a[..., 0] ^ b[..., 0]) + np.where(_same_size(a[..., 1], b[..., 1], percent), 0, 65)

    return bits


def _same_size(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    return np.abs(a - b) <= (100 - percent) * np.maximum(a, b) // 100


def _letters(a: bytes) -> np.ndarray:
    """The characters' numbers."""
    return np.frombuffer(a, np.uint8) if a.isascii() else np.frombuffer(a.decode().encode("utf-32-le"), "<u4")


def edit_distance(a: bytes, b: bytes, most: int) -> int:
    """The Levenshtein distance of characters, or more than ``most`` where it is more."""
    if a == b:
        return 0
    x, y = _letters(a), _letters(b)
    if abs(len(x) - len(y)) > most:
        return most + 1
    n = min(len(x), len(y))
    same = x[:n] == y[:n]
    head = n if same.all() else int(same.argmin())
    n -= head
    same = x[len(x) - n :][::-1] == y[len(y) - n :][::-1]
    tail = n if same.all() else int(same.argmin())
    return _banded(x[head : len(x) - tail].tolist(), y[head : len(y) - tail].tolist(), most)


def _banded(a: list[int], b: list[int], most: int) -> int:
    """The distance of two sequences of numbers, or more than ``most``.

    The table's cells within ``most`` of the diagonal are bits of integers that move down with it; the distance is followed along the band's lower edge, where
    it can only grow, and then along the last row, where it can fall by one a letter.
    """
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    most = min(most, len(a))
    if len(a) - len(b) > most:
        return most + 1
    width = 2 * most + 1
    full, edge = (1 << width) - 1, 1 << width - 1
    at: dict[int, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    up, down, score = ((1 << most + 1) - 1) << most & full, 0, most
    last = 2 * most + len(b) - len(a)
    turn, shift = len(a) - most, -most
    row = edge >> 1
    for j, c in enumerate(b):
        eq = at.get(c, 0)
        eq = (eq >> shift if shift > 0 else eq << -shift) & full
        shift += 1
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & full
        more, less = down | full & ~(diagonal | up), diagonal & up
        if j < turn:
            score += not diagonal & edge
        else:
            score += bool(more & row) - bool(less & row)
            row >>= 1
        if score > last:
            return most + 1
        diagonal >>= 1
        up, down = less | full & ~(diagonal | more), diagonal & more
    return score


def _documents(docs: DataFrame) -> DataFrame:
    """(doc, mark, text): a document is told by its id and a hash of its text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc, mark, pos, id, check, sig) of each line with a normal form; id and check are its 128-bit hash."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, held in slices(x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column("text")):
                found = Lines(held)
                take = pa.array(at + found.text)
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(take), batch.column("mark").take(take), pa.array(found.pos.astype(np.int32)), pa.array(found.digest[:, 0]), pa.array(found.digest[:, 1]), found.sig], ["doc", "mark", "pos", "id", "check", "sig"])

    return _documents(docs).withColumn("text", F.col("text").cast("binary")).mapInArrow(lines, "doc long, mark long, pos int, id long, check long, sig binary")


def block_keys(signature: bytes) -> np.ndarray:
    return np.frombuffer(signature, "<u8")[2:]


def _keys_and_ids(batch: pa.RecordBatch) -> np.ndarray:
    """A row (key, id) for each block of each line of ``batch`` (id, sig)."""
    sig = batch.column("sig").to_pylist()
    flat, count = np.frombuffer(b"".join(sig), "<u8"), np.array([len(v) // 8 for v in sig])
    stays, first = np.ones(len(flat), bool), np.cumsum(count) - count
    stays[first] = stays[first + 1] = False
    return np.column_stack([flat[stays], np.repeat(batch.column("id").to_numpy(), count - 2).view("<u8")])


class Shared:
    """The pairs (key, id) of a range of keys that have several ids, each as soon as it is known, so that no more than one pair a key and ``most`` others are held."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.held: list[np.ndarray] = []
        self.count, self.known = 0, np.empty(0, np.uint64)

    def add(self, pairs: np.ndarray) -> np.ndarray | None:
        self.held.append(pairs)
        self.count += len(pairs)
        return self.found() if self.count > self.most else None

    def found(self) -> np.ndarray | None:
        """The pairs of such keys among those held, without repeats; the others stay."""
        if not self.held:
            return None
        pairs = np.concatenate(self.held)
        pairs = pairs[np.argsort(pairs[:, 0])]
        same = pairs[1:, 0] == pairs[:-1, 0]
        again = np.append(False, same) | np.append(same, False)
        several, single = pairs[again], pairs[~again]
        several = several[np.lexsort((several[:, 1], several[:, 0]))]
        several = several[np.append(True, (several[1:] != several[:-1]).any(axis=1))[: len(several)]]
        same = several[1:, 0] == several[:-1, 0]
        again = (np.append(False, same) | np.append(same, False))[: len(several)]
        out, single = several[again], np.concatenate([single, several[~again]])
        if len(self.known):
            met = np.isin(single[:, 0], self.known)
            out, single = np.concatenate([out, single[met]]), single[~met]
        self.known = np.union1d(self.known, out[:, 0])
        self.held, self.count = [single], 0
        return out


def shared_keys(lines: DataFrame) -> DataFrame:
    """(key, id), each once, of the keys that different lines have, from ``lines`` (id, sig), a written table that may hold a line several times.

    Tasks send packed pairs by range of keys, as nearly all keys are of one line only.
    """
    bits = min(15, (12 * lines.count() // RANGE_KEYS).bit_length())
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                pairs = _keys_and_ids(x)
                part = (pairs[:, 0] >> np.uint64(48)).astype(np.uint16) >> np.uint16(16 - bits) if bits else np.zeros(len(pairs), np.uint16)
                pairs, count = pairs[np.argsort(part, kind="stable")], np.bincount(part, minlength=1 << bits)
                ends = np.concatenate(([0], 16 * np.cumsum(count))).astype(np.int32)
                sent = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(ends), pa.py_buffer(pairs.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(count), dtype=np.int32)), sent], ["part", "pairs"]).filter(pa.array(count > 0))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: np.ndarray | None) -> Iterator[pa.RecordBatch]:
            if found is not None and len(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k]).view(np.int64)) for k in (0, 1)], schema=schema)

        now, held = -1, Shared(2 * RANGE_KEYS)
        for x in batches:
            for part, sent in zip(x.column("part").to_pylist(), x.column("pairs"), strict=True):
                if part != now:
                    yield from rows(held.found())
                    now, held = part, Shared(2 * RANGE_KEYS)
                yield from rows(held.add(np.frombuffer(sent.as_buffer(), "<u8").reshape(-1, 2)))
        yield from rows(held.found())

    sent = lines.select("id", "sig").mapInArrow(send, "part int, pairs binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "key long, id long").distinct()


def similar(a: bytes, b: bytes, percent: int) -> bool:
    most = (100 - percent) * max(len(_letters(a)), len(_letters(b))) // 100
    return edit_distance(a, b, most) <= most


def most_edits(a: list[str], b: list[str]) -> int:
    """A distance that two texts of these words don't exceed: of words that differ one is left out, if that makes the next ones equal, or both change places."""
    i = j = edits = 0
    while i < len(a) and j < len(b):
        x, y = a[i], b[j]
        if x == y:
            i, j = i + 1, j + 1
        elif i + 1 < len(a) and a[i + 1] == y:
            i, edits = i + 1, edits + len(x) + 1
        elif j + 1 < len(b) and x == b[j + 1]:
            j, edits = j + 1, edits + len(y) + 1
        else:
            i, j, edits = i + 1, j + 1, edits + (sum(map(ne, x, y)) if len(x) == len(y) else max(len(x), len(y)))
    return edits + sum(len(x) + 1 for x in a[i:]) + sum(len(x) + 1 for x in b[j:])


class Forms:
    """Normal forms whose pairs are compared many at a time: ``near`` tells which pairs have the edit similarity."""

    #: Pairs that are compared at once.
    AT_ONCE = 4096
    #: Integers that the masks of the pairs measured at once may take, all of them and those of 64 steps.
    MASKS, STEP_MASKS = 1 << 21, 1 << 17
    #: Bands of up to so many machine words are measured for many pairs at once.
    BANDS = (1, 3, 8, 16, 32)

    def __init__(self, held: list[bytes], percent: int) -> None:
        self.percent = percent
        self.held, self.words = held, {}
        letters = [_letters(x).astype(np.int32) for x in held]
        self.size = np.array([len(x) for x in letters], np.int64)
        self.start = np.cumsum(self.size) - self.size
        flat = np.concatenate(letters) if letters else np.empty(0, np.int32)
        seen = np.zeros(int(flat.max(initial=0)) + 1, bool)
        seen[flat] = True
        self.codes = (np.cumsum(seen) - 1)[flat]
        self.symbols = int(seen.sum())
        self.counts = np.bincount(np.repeat(np.arange(len(held)), self.size) * 64 + self.codes % 64, minlength=64 * len(held)).reshape(-1, 64).astype(np.int32)

    def _words(self, i: int) -> list[str]:
        if i not in self.words:
            self.words[i] = self.held[i].decode().split(" ")
        return self.words[i]

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        for at in range(0, len(a), self.AT_ONCE):
            out[at : at + self.AT_ONCE] = self._near(a[at : at + self.AT_ONCE], b[at : at + self.AT_ONCE])
        return out

    def _near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = (100 - self.percent) * np.maximum(self.size[a], self.size[b]) // 100
        # An edit changes the length by one at most, and the counts of letters by two.
        out = (np.abs(self.size[a] - self.size[b]) <= most) & (np.abs(self.counts[a] - self.counts[b]).sum(axis=1) <= 2 * most)
        left = np.flatnonzero(out)
        head, tail = self._same_ends(a[left], b[left])
        most, start_a, start_b = most[left], self.start[a[left]] + head, self.start[b[left]] + head
        size_a, size_b = self.size[a[left]] - head - tail, self.size[b[left]] - head - tail
        # Where the longer middle is no more than the edits allowed, or changes of whole words are, the pair is near; the others' middles are measured.
        open_ = np.flatnonzero(np.maximum(size_a, size_b) > most)
        open_ = open_[[most_edits(self._words(a[left[i]]), self._words(b[left[i]])) > most[i] for i in open_.tolist()]] if len(open_) else open_
        for words, own in self._groups(most[open_], size_a[open_], size_b[open_]):
            own = open_[own]
            # A step over all pairs costs as much as some 15 steps of one pair.
            if not words or len(own) < 15:
                for i in own.tolist():
                    x, y = (self.codes[start[i] : start[i] + size[i]].tolist() for start, size in ((start_a, size_a), (start_b, size_b)))
                    out[left[i]] = _banded(x, y, int(most[i])) <= most[i]
                continue
            out[left[own]] = self._distances(start_a[own], size_a[own], start_b[own], size_b[own], most[own], words) <= most[own]
        return out

    def _same_ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lengths of the common beginnings, and of the common ends of what follows."""
        head, tail = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        for i, (x, y, nx, ny) in enumerate(zip(self.start[a].tolist(), self.start[b].tolist(), self.size[a].tolist(), self.size[b].tolist(), strict=True)):
            n = min(nx, ny)
            other = self.codes[x : x + n] != self.codes[y : y + n]
            h = int(other.argmax()) if n else 0
            if n and not other[h]:
                h = n
            n -= h
            other = self.codes[x + nx - n : x + nx] != self.codes[y + ny - n : y + ny]
            t = int(other[::-1].argmax()) if n else 0
            if n and not other[n - 1 - t]:
                t = n
            head[i], tail[i] = h, t
        return head, tail

    def _groups(self, most: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(machine words of the band, pairs) in order of falling length of ``b``, as many at once as their masks have room for; 0 for wider bands."""
        band = np.searchsorted(32 * np.array(self.BANDS) - 1, most)
        for k in np.unique(band).tolist():
            own = np.flatnonzero(band == k)
            own = own[np.argsort(-b[own], kind="stable")]
            words = self.BANDS[k] if k < len(self.BANDS) else 0
            planes = int(np.maximum(a[own], b[own]).max()) // 64 + words + 2
            room = max(15, min(self.MASKS // planes, self.STEP_MASKS) // self.symbols)
            for at in range(0, len(own), room):
                yield words, own[at : at + room]

    def _distances(self, start_a: np.ndarray, size_a: np.ndarray, start_b: np.ndarray, size_b: np.ndarray, most: np.ndarray, words: int) -> np.ndarray:
        """Levenshtein distances, right where they are at most ``most`` and else greater; longest ``b`` first.

        As in ``_banded`` the cells next to the diagonal are bits, here of ``words`` machine words a pair, and a step takes a letter of every ``b``. The distance
        is followed along the diagonal that ends in the last cell, where it never falls, so that pairs beyond ``most`` are dropped on the way.
        """
        one, n, half = np.uint64(1), len(size_a), 32 * words - 1
        planes = max(half + int(size_a.max()), int(size_b[0])) // 64 + words + 2
        owner = np.repeat(np.arange(n), size_a)
        pos = np.arange(len(owner)) - np.repeat(np.cumsum(size_a) - size_a, size_a)
        at = owner * self.symbols + self.codes[start_a[owner] + pos]
        pos += half
        masks = np.zeros((planes, n * self.symbols), np.uint64)
        np.add.at(masks.reshape(-1), (pos >> 6) * masks.shape[1] + at, one << (pos & 63).astype(np.uint64))
        up, down = np.zeros((words, n), np.uint64), np.zeros((words, n), np.uint64)
        up[half >> 6] = ~np.uint64(0) << np.uint64(half & 63)
        up[(half >> 6) + 1 :] = ~np.uint64(0)
        last = size_a - size_b + half
        word, bit = last >> 6, (last & 63).astype(np.uint64)
        out, ids, row = most + 1, np.arange(n), np.arange(n) * self.symbols
        score, k = np.maximum(size_a - size_b, 0), n
        for j in range(int(size_b[0])):
            while k and size_b[k - 1] <= j:
                k -= 1
            if j and j % 64 == 0:
                out[ids[k:]] = score[k:]
                alive = np.flatnonzero(score[:k] <= most[:k])
                ids, row, start_b, size_b, most, word, bit, score = (x[alive] for x in (ids, row, start_b, size_b, most, word, bit, score))
                up, down, k = up[:, alive], down[:, alive], len(alive)
            if not k:
                break
            found = masks[j >> 6 : (j >> 6) + words + 1].take(row[:k] + self.codes[start_b[:k] + j], axis=1)
            shift = np.uint64(j & 63)
            eq = found[:-1] >> shift | found[1:] << (np.uint64(64) - shift) if shift else found[:-1]
            p, m = up[:, :k], down[:, :k]
            total = eq & p
            total += p
            if words > 1:
                over = total < p
                carry = over[0]
                for w in range(1, words):
                    total[w] += carry
                    carry = over[w] | (carry & (total[w] == 0))
            total ^= p
            total |= eq
            total |= m
            score[:k] += ~((total[0] if words == 1 else total[word[:k], np.arange(k)]) >> bit[:k]).astype(np.int64) & 1
            more = total | p
            np.invert(more, out=more)
            more |= m
            less = total & p
            moved = total >> one
            if words > 1:
                moved[:-1] |= total[1:] << np.uint64(63)
            np.bitwise_and(moved, more, out=m)
            moved |= more
            np.invert(moved, out=moved)
            np.bitwise_or(less, moved, out=p)
        out[ids] = score
        return out


class _Exact:
    """Checks on normal forms, which are worked out anew from the texts that hold the lines in question."""

    def __init__(self, docs: DataFrame, rows: DataFrame, stage: Staging, percent: int) -> None:
        self.docs, self.rows, self.stage, self.percent = _documents(docs), rows, stage, percent

    def forms(self, ids: DataFrame) -> DataFrame:
        """(id, held) of the lines: the normal form."""

        def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                ids, held = [], []
                for text, wanted in zip(x.column("text"), x.column("wanted"), strict=True):
                    split = text.as_py().split("\n")
                    for w in wanted.as_py():
                        ids.append(w["id"])
                        held.append(normal(split[w["pos"]]).encode())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.binary())], ["id", "held"])

        places = keep_ids(self.rows.select("id", "doc", "mark", "pos"), ids, "id").dropDuplicates(["id"])
        wanted = places.groupBy("doc", "mark").agg(F.collect_list(F.struct("id", "pos")).alias("wanted"))
        wanted = self.stage.put(wanted, "wanted")
        few = (wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0) <= BROADCAST_IDS
        found = self.docs.join(F.broadcast(wanted) if few else wanted, ["doc", "mark"])
        return self.stage.put(found.select("text", "wanted").mapInArrow(forms, "id long, held binary").dropDuplicates(["id"]), "forms")

    def verify(self, pairs: DataFrame) -> DataFrame:
        percent = self.percent

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                forms, at = Forms(x.column("ha").to_pylist() + x.column("hb").to_pylist(), percent), np.arange(x.num_rows)
                yield x.select(["a", "b"]).filter(pa.array(forms.near(at, at + x.num_rows)))

        pairs = self.stage.put(pairs.select("a", "b"), "pairs")
        held = self.forms(pairs.select("a").union(pairs.select("b")).toDF("id").distinct())
        left, right = (held.select(F.col("id").alias(c), F.col("held").alias(f"h{c}")) for c in "ab")
        links = self.stage.put(pairs.join(left, "a").join(right, "b").mapInArrow(compare, "a long, b long"), "verified")
        self.stage.drop(held)
        return links

    def across(self, rows: DataFrame, signatures: DataFrame) -> DataFrame:
        """The links of different components inside mixed buckets; a pair is compared in the first block that it shares only."""
        percent = self.percent

        def nearby(x: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
            sig, group, own = x.column("sig").to_pylist(), x.column("component").to_numpy(), x.column("own").to_numpy()
            i, j, n = x.column("i")[0].as_py(), x.column("j")[0].as_py(), x.num_rows
            flat, count = np.frombuffer(b"".join(sig), "<u8"), np.array([len(v) // 8 for v in sig])
            first = np.cumsum(count) - count
            size = flat[first + 1]
            fits = (group[:, None] != group) & _same_size(size[:, None], size, percent)
            fits = np.triu(fits, 1) if i == j else fits & (own == i)[:, None] & (own == j)
            if not fits.any():
                return
            # The keys before this one: a pair belongs to the first key that it shares.
            is_key = np.ones(len(flat), bool)
            is_key[first] = is_key[first + 1] = False
            before = np.flatnonzero(is_key & (flat < np.uint64(x.column("key")[0].as_py() & 2**64 - 1)))
            owner, keys = np.repeat(np.arange(n), count)[before], flat[before]
            order = np.argsort(keys, kind="stable")
            owner, keys = owner[order], keys[order]
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if hi - lo > 1:
                    met = owner[lo:hi]
                    fits[met[:, None], met] = False
            for at in np.flatnonzero(fits.any(axis=1)).tolist():
                yield at, np.flatnonzero(fits[at])

        return links_across(rows, signatures, self.forms, nearby, lambda held: Forms([x.to_pybytes() for x in held], percent).near, self.stage, PAIRS_AT_ONCE, TOGETHER)


def duplicate_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc, mark, gone): the line numbers that each document loses; documents that lose none are left out. ``percent`` is 90 or more."""
    if not PERCENT <= percent <= 100:
        raise ValueError(f"percent must be from {PERCENT} to 100: the blocks are made for {PERCENT}")
    stage = Staging(docs.sparkSession, "lines")
    small_batches(docs.sparkSession)
    rows = stage.put(occurrences(docs), "occurrences")
    keys = stage.put(shared_keys(rows), "keys")
    signatures = stage.put(keep_ids(rows.select("id", "sig"), keys.select("id").distinct(), "id").dropDuplicates(["id"]), "signatures")
    exact = _Exact(docs, rows, stage, percent)
    heads = signatures.select("id", F.substring("sig", 1, 16).alias("sig"))
    found, _ = link(keys, heads, distance(percent), "<u8", 64, exact.verify, lambda mixed: exact.across(mixed, signatures), stage)
    places = rows.select("doc", "mark", "pos", "id", "check")
    repeated = stage.put(places.groupBy("id", "check").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    grouped = spread_join(spread_join(places, repeated, ["id", "check"], "left"), found, ["id"], "left").where("n > 1 or component is not null")
    grouped = stage.put(grouped.select("doc", "mark", "pos", F.coalesce("component", "id").alias("component")), "grouped")
    firsts = stage.put(grouped.groupBy("component").agg(F.min(F.struct("doc", "mark", "pos")).alias("stays")), "firsts")
    again = spread_join(grouped, firsts, ["component"]).where(F.struct("doc", "mark", "pos") != F.col("stays"))
    return stage.put(again.select("doc", "mark", "pos").distinct().groupBy("doc", "mark").agg(F.sort_array(F.collect_list("pos")).alias("gone")), "gone")


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the duplicate lines removed from ``text``, and n_lines, n_removed of each row.

    The two columns replace columns of these names.
    """
    gone = duplicate_lines(docs, percent)
    columns = docs.columns
    held = docs.select(F.struct(*(docs[x] for x in columns)).alias("row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(docs["text"]).alias("mark"))
    held = held.join(gone, ["doc", "mark"], "left").withColumn("lines", F.split("row.text", "\n", -1))
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(stays, lambda i: F.col("lines")[i]), "\n"))
    kept = [text.alias(x) if x == "text" else F.col("row")[x].alias(x) for x in columns if x not in ("n_lines", "n_removed")]
    return held.select(*kept, F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, text_sha256) of the rows of ``dedup_lines``."""
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
