"""Exact Jaccard join of word shingles, heavy and light: subsets of fixed size for small sets, inverted lists for large ones.

A document's set holds its distinct shingles of four words, A-Z lower-cased; one of fewer words has its whole word sequence as the only shingle; one without words has none and is
linked with nothing. Documents are linked if 100 * intersection >= 85 * union of their full sets. Equal sets are collapsed first.

Light sets, of up to ``boundary`` shingles, meet in subsets: sets of n and m shingles are linked if they share c = ceil(85 (n + m) / 185), so each gives a key for each of its
subsets of the sizes c that its partners' sizes ask for, and linked sets share a subset of that size. Pairs with a larger set meet in inverted lists. Lists hold a set under its rarest shingles only: a set of n
may miss n - ceil(0.85 n) of a partner's, so of its n shingles in a common order that many and one more are enough. The order is by the count of documents, as far as
a shingle is frequent, then by hash. Light sets whose partners can be larger are in the lists as well.

The boundary is where the estimated cost is least: a subset costs a row; an entry in a list costs a row and a comparison with each other entry. The lengths of the lists that small sets are in are
counted for it. The result doesn't depend on it.

Frequent shingles are counted over all documents: tasks send packed counts by hash range, and the ranges hand on what reaches ``FREQUENT``. If these are more than ``MOST_FREQUENT``,
only the most frequent are told apart, as any order is right.

Sets that share a key are compared as ``linking`` does: by stars first, then across components in blocks. Sizes and a parity bitmap bound the difference of two sets from below, so that
no pair within the threshold is left out before the full sets are compared.

Defined cases: null or blank text has an empty set; rows that share a doc_id are one document; a null doc_id has a null component; extra columns are ignored; an empty table
gives an empty result. ``doc_id`` is an integer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm import near_dedup
from sondage.llm.common import BROADCAST_IDS, Staging, keep_ids, small_batches, spread_join
from sondage.llm.linking import each_block_pair, in_blocks, link, links_across, matrix, near_in_block
from sondage.llm.words import mix, shingle_sets

WIDTH, PERCENT = 4, 85
#: Largest sets whose subsets may be enumerated.
LIGHT = 26
#: Cost of a comparison in a list, in rows.
COMPARISON = 0.05
#: Least count of documents that makes a shingle frequent, and most frequent ones that are told apart.
FREQUENT, MOST_FREQUENT = 32, 1_000_000
#: Bits of a hash inside a range of hashes, and about how many shingles a range holds.
RANGE_BITS, RANGE_SHINGLES = 22, 1_000_000
#: Hashes that a task holds before it sends their counts.
HELD = 1_000_000
#: Bits of the parity bitmap.
BITMAP = 2048
#: Least sets that have a second bitmap, as the bits of the first one can't tell them apart, and its least bits.
LONG, LONG_BITMAP = 4096, 8192
_FAR = 1 << 30


def least_shared(n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Shingles that sets of n and m share if they are linked, or more."""
    return -(-percent * (n + m) // (100 + percent))


def list_entries(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def subset_sizes(n: int, boundary: int, percent: int) -> list[int]:
    """The sizes of the subsets of a set of n that its light partners ask for."""
    partners = range(-(-percent * n // 100), min(boundary, 100 * n // percent) + 1)
    return sorted({c for m in partners if m and (c := least_shared(n, m, percent)) <= min(n, m)})


def subset_count(n: int, boundary: int, percent: int) -> int:
    return sum(comb(n, c) for c in subset_sizes(n, boundary, percent))


@cache
def _left_out(n: int, count: int) -> np.ndarray:
    return np.array(list(combinations(range(n), count)), np.int64).reshape(comb(n, count), count)


def subset_keys(hashes: np.ndarray, boundary: int, percent: int) -> np.ndarray:
    """A key for each subset: the sum of its hashes, that of all less that of those left out."""
    own = mix(hashes)
    total = own.sum(dtype=np.uint64)
    return np.concatenate([mix(total - own[_left_out(len(own), len(own) - c)].sum(axis=1, dtype=np.uint64) + np.uint64(c)) for c in subset_sizes(len(own), boundary, percent)])


def parity(hashes: np.ndarray, bits: int = BITMAP) -> np.ndarray:
    """Bits that count the hashes of each residue, modulo two; the bits that differ between two sets are at most as many as their members that differ."""
    return np.packbits((np.bincount((hashes >> np.uint64(20)).astype(np.int64) & bits - 1, minlength=bits) & 1).astype(bool)).view("<u8")


def bound(percent: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A lower bound of the members that differ, of heads (size, parity); ``_FAR`` where it is too large for a link."""

    def differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, m = a[..., 0].astype(np.int64), b[..., 0].astype(np.int64)
        bits = np.bitwise_count(a[..., 1:] ^ b[..., 1:]).sum(axis=-1, dtype=np.int64)
        least = np.maximum(bits, np.abs(n - m))
        return np.where(least <= n + m - 2 * least_shared(n, m, percent), least, _FAR)

    return differ


def long_bits(n: int) -> int:
    """The bits of the second bitmap of a set of n, 0 for those without one: a link needs that fewer than 0.17 n of them differ, and of unrelated sets about half do."""
    return max(LONG_BITMAP, 1 << n.bit_length() - 1) if n >= LONG else 0


class Heads:
    """Heads (size, parity) of a block with the second bitmaps of its long sets: ``near`` tells which pairs may be linked by both."""

    def __init__(self, heads: np.ndarray, bitmaps: list[bytes | None], percent: int) -> None:
        self.heads, self.percent, self.differ = heads, percent, bound(percent)
        self.bits = np.array([8 * len(x or b"") for x in bitmaps], np.int64)
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for bits in np.unique(self.bits[self.bits > 0]).tolist():
            # A wider bitmap folds to this one: the parity of a residue is that of all those that fall on it.
            own = np.flatnonzero(self.bits >= bits)
            row = np.full(len(bitmaps), -1)
            row[own] = np.arange(len(own))
            self.folded[bits] = row, np.stack([np.bitwise_xor.reduce(np.frombuffer(bitmaps[i], "<u8").reshape(-1, bits // 64), axis=0) for i in own.tolist()])

    def near(self, at: int, others: np.ndarray) -> np.ndarray:
        out = self.differ(self.heads[at], self.heads[others]) < _FAR
        common = np.where(out, np.minimum(self.bits[at], self.bits[others]), 0)
        for bits in np.unique(common[common > 0]).tolist():
            own = np.flatnonzero(common == bits)
            row, held = self.folded[bits]
            least = np.bitwise_count(held[row[at]] ^ held[row[others[own]]]).sum(axis=-1, dtype=np.int64)
            n, m = self.heads[at, 0].astype(np.int64), self.heads[others[own], 0].astype(np.int64)
            out[own] = least <= n + m - 2 * least_shared(n, m, self.percent)
        return out


class Frequent:
    """Counts of the frequent shingles by the first bits of their hashes."""

    def __init__(self, shift: int, keys: np.ndarray, counts: np.ndarray) -> None:
        self.shift, self.keys, self.counts = np.uint64(shift), keys, counts

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """0 for those that aren't frequent."""
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64)
        short = hashes >> self.shift
        at = np.searchsorted(self.keys, short)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == short, self.counts[at], 0)

    def rarest(self, hashes: np.ndarray, count: int) -> np.ndarray:
        """The first ``count`` of sorted hashes by (count of documents, hash)."""
        often = self.of(hashes)
        rare = hashes[often == 0]
        if len(rare) >= count:
            return rare[:count]
        rest = np.flatnonzero(often)
        return np.concatenate((rare, hashes[rest[np.argsort(often[rest], kind="stable")[: count - len(rare)]]]))


def _texts(docs: DataFrame, name: str = "doc_id") -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias(name), F.col("text").cast("string").cast("binary").alias("text"))


def _bytes(column: pa.Array) -> Iterator[bytes]:
    return (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column)


def frequent(docs: DataFrame, stage: Staging) -> Frequent:
    """The shingles in ``FREQUENT`` documents or more, at most ``MOST_FREQUENT`` of them, with their counts."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(size / 6 / RANGE_SHINGLES).bit_length())
    shift = np.uint64(64 - bits - RANGE_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            part = (found >> np.uint64(RANGE_BITS)).astype(np.int64)
            first = np.flatnonzero(np.diff(part, prepend=-1))
            low = np.ascontiguousarray((found & np.uint64((1 << RANGE_BITS) - 1)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])
            ends = list(zip(first.tolist(), [*first[1:].tolist(), len(found)], strict=True))
            n = n.astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array([low[a:b].tobytes() for a, b in ends], pa.binary()), pa.array([n[a:b].tobytes() for a, b in ends], pa.binary())], ["part", "low", "n"])

        for batch in batches:
            for hashes, _ in shingle_sets(_bytes(batch.column("text")), width=WIDTH):
                held.append(hashes >> shift)
                size += len(hashes)
                if size >= HELD:
                    yield from out()
                    size = 0
        if size:
            yield from out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros(1 << RANGE_BITS, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            often = np.flatnonzero(sums >= FREQUENT)
            if len(often):
                yield pa.RecordBatch.from_arrays([pa.array(now << RANGE_BITS | often), pa.array(sums[often])], ["key", "n"])
            sums[:] = 0

        for batch in batches:
            for part, low, n in zip(batch.column("part").to_pylist(), batch.column("low").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if part != now:
                    if now is not None:
                        yield from out()
                    now = part
                raw = np.zeros((len(low) // 3, 4), np.uint8)
                raw[:, :3] = np.frombuffer(low, np.uint8).reshape(-1, 3)
                sums[raw.view("<u4").ravel()] += np.frombuffer(n, "<u4")  # each once in a message
        if now is not None:
            yield from out()

    sent = _texts(docs).mapInArrow(count, "part long, low binary, n binary")
    found = stage.put(sent.repartition("part").sortWithinPartitions("part").mapInArrow(add, "key long, n long"), "frequent")
    held = dict(found.groupBy(F.floor(F.log2("n"))).count().collect())
    least, total = 62, 0
    for size in sorted(held, reverse=True):
        total += held[size]
        if total > MOST_FREQUENT:
            break
        least = size
    rows = found.where(F.col("n") >= F.lit(1 << least)).toArrow()
    keys, n = (rows.column(c).to_numpy() for c in ("key", "n"))
    order = np.argsort(keys)
    return Frequent(int(shift), keys[order].astype(np.uint64), n[order])


def features(docs: DataFrame, order: Frequent, percent: int) -> DataFrame:
    """(doc_id, n_shingles, digest, head, bitmap, rarest, light) of each row; all but the first two are null for an empty set, ``light`` for a large one and the second ``bitmap`` for one that isn't long as well."""
    sent = docs.sparkSession.sparkContext.broadcast(order)
    names = ["doc_id", "n_shingles", "digest", "head", "bitmap", "rarest", "light"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = sent.value
        for batch in batches:
            rows = []
            for hashes, _ in shingle_sets(_bytes(batch.column("text")), width=WIDTH):
                n = len(hashes)
                if n:
                    head = np.concatenate((np.array([n], "<u8"), parity(hashes)))
                    rows.append((n, hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), head.tobytes(), parity(hashes, bits).tobytes() if (bits := long_bits(n)) else None, order.rarest(hashes, list_entries(n, percent)).tobytes(), hashes.tobytes() if n <= LIGHT else None))
                else:
                    rows.append((0, None, None, None, None, None))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(columns[0], pa.int64()), *(pa.array(x, pa.binary()) for x in columns[1:])], names)

    return _texts(docs).mapInArrow(measure, "doc_id long, n_shingles long, digest binary, head binary, bitmap binary, rarest binary, light binary")


def _entries(texts: DataFrame) -> DataFrame:
    """(key, id, n) of all inverted lists."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rarest = x.column("rarest").to_pylist()
            count = [len(v) // 8 for v in rarest]
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(rarest), np.int64)), *(pa.array(np.repeat(x.column(c).to_numpy(), count)) for c in ("id", "n"))], ["key", "id", "n"])

    return texts.select("id", "n", "rarest").mapInArrow(spread, "key long, id long, n long")


def boundary(texts: DataFrame, stage: Staging, percent: int) -> int:
    """The size up to which sets are light, where the estimated cost is least."""
    small = stage.put(_entries(texts.where(F.col("n") <= LIGHT)), "small")
    wanted = stage.put(small.select("key").distinct(), "wanted")
    few = wanted.count() <= BROADCAST_IDS
    lengths = _entries(texts).join(F.broadcast(wanted) if few else wanted, "key", "left_semi").groupBy("key").agg(F.count("*").alias("length"))
    # A row for each list and size, so no list is met by all its entries.
    by_size = small.groupBy("key", "n").agg(F.count("*").alias("entries")).join(lengths, "key")
    cost = {r.n: r.entries + COMPARISON * r.met for r in by_size.groupBy("n").agg(F.sum("entries").alias("entries"), F.sum(F.col("entries") * F.col("length")).alias("met")).collect()}
    sets = dict(texts.where(F.col("n") <= LIGHT).groupBy("n").count().collect())

    def total(edge: int) -> float:
        listed = sum(x for n, x in cost.items() if 100 * n >= percent * (edge + 1))
        return listed + sum(count * subset_count(n, edge, percent) for n, count in sets.items() if n <= edge)

    return min(range(LIGHT + 1), key=total)


def with_keys(texts: DataFrame, edge: int, percent: int) -> DataFrame:
    """(id, head, bitmap, keys) of the sets: subsets of the light ones, lists of those whose partners can be larger than ``edge``."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out = []
            for n, rarest, light in zip(x.column("n").to_pylist(), x.column("rarest").to_pylist(), x.column("light").to_pylist(), strict=True):
                listed = rarest if 100 * n >= percent * (edge + 1) else b""
                out.append(listed + subset_keys(np.frombuffer(light, np.uint64), edge, percent).tobytes() if n <= edge else listed)
            yield pa.RecordBatch.from_arrays([x.column("id"), x.column("head"), x.column("bitmap"), pa.array(out, pa.binary())], ["id", "head", "bitmap", "keys"])

    return texts.select("id", "n", "head", "bitmap", "rarest", "light").mapInArrow(keys, "id long, head binary, bitmap binary, keys binary")


def _rows_of_keys(sets: DataFrame) -> DataFrame:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keys = x.column("keys").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(keys), np.int64)), pa.array(np.repeat(x.column("id").to_numpy(), [len(k) // 8 for k in keys]))], ["key", "id"])

    return sets.select("id", "keys").mapInArrow(spread, "key long, id long")


class _Exact(near_dedup._Exact):
    """Checks on full sets, which are worked out anew from the texts of the documents in question."""

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, held) of the documents."""

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                yield pa.RecordBatch.from_arrays([x.column("id"), pa.array([h.tobytes() for h, _ in shingle_sets(_bytes(x.column("text")), width=WIDTH)], pa.binary())], ["id", "held"])

        return self.stage.put(keep_ids(self.texts, ids, "id").mapInArrow(sets, "id long, held binary"), "sets")

    def between(self, rows: DataFrame, sets: DataFrame) -> DataFrame:
        """The links of different components inside mixed buckets. A pair is compared under the first key only that it shares.

        Members without a near partner by size and parity go first, as the keys that tell which is the first one are many times longer.
        """
        rows, percent = self.stage.put(rows, "mixed"), self.percent
        size = 8 + BITMAP // 8

        def screen(x: pa.Table) -> pa.RecordBatch | None:
            heads, wanted = Heads(matrix(x.column("head").combine_chunks(), "<u8"), x.column("bitmap").to_pylist(), percent), np.zeros(x.num_rows, bool)
            for at, others in near_in_block(x, heads.near):
                wanted[at] = True
                wanted[others] = True
            return x.select(["key", "id", "component"]).filter(pa.array(wanted)).combine_chunks().to_batches()[0] if wanted.any() else None

        left = each_block_pair(in_blocks(rows.join(sets.select("id", "head", "bitmap"), "id")), screen, "key long, id long, component long").distinct()
        left = self.stage.put(left, "screened")
        # A pair that is near by its heads is left under each key that it shares, so the first of these is the first of all.
        own = left.groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("keys")).join(sets.select("id", "head", "bitmap"), "id")
        own = self.stage.put(own, "left-keys")
        rows = left.join(left.groupBy("key").agg(F.count("*").alias("n")), "key")

        def nearby(x: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
            sig = x.column("sig").to_pylist()
            head, this = np.frombuffer(b"".join(v[:size] for v in sig), "<u8").reshape(len(sig), -1), x.column("key")[0].as_py()
            ends = [size + long_bits(n) // 8 for n in head[:, 0].tolist()]
            heads = Heads(head, [v[size:end] for v, end in zip(sig, ends, strict=True)], percent)
            before = [k[k < this] for k in (np.frombuffer(v, ">i8", offset=end) for v, end in zip(sig, ends, strict=True))]
            count = np.array([len(k) for k in before])

            def near(at: int, others: np.ndarray) -> np.ndarray:
                out = heads.near(at, others)
                left = np.flatnonzero(out & (count[others] > 0))
                if len(left) and count[at]:
                    flat = np.concatenate([before[i] for i in others[left].tolist()])
                    where = np.searchsorted(before[at], flat)
                    where[where == count[at]] = 0
                    first = np.cumsum(count[others[left]]) - count[others[left]]
                    out[left[np.logical_or.reduceat(before[at][where] == flat, first)]] = False
                return out

            return near_in_block(x, near)

        def test(found: list[pa.Buffer]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
            held = [np.frombuffer(x, np.uint64) for x in found]
            return lambda a, b: np.array([near_dedup.alike(held[x], held[y], percent) for x, y in zip(a.tolist(), b.tolist(), strict=True)], bool)

        keys = F.unhex(F.array_join(F.transform("keys", lambda k: F.lpad(F.hex(k), 16, "0")), ""))
        return links_across(rows, own.select("id", F.concat("head", F.coalesce("bitmap", F.lit(b"")), keys).alias("sig")), self.sets, nearby, test, self.stage)


def jaccard_links(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(components, classes): (id, component) of the sets with a link, and (doc_id, n_shingles, digest, id) of each row with the smallest doc_id of its equal sets."""
    stage = Staging(docs.sparkSession, "jaccard")
    small_batches(docs.sparkSession)
    measured = stage.put(features(docs, frequent(docs, stage), percent).withColumn("row", F.monotonically_increasing_id()), "features")
    rows = stage.put(measured.select("doc_id", "n_shingles", "digest"), "rows")
    # One row of each group of equal sets, found by its number, so that keys aren't shuffled.
    firsts = measured.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("x"))
    firsts = stage.put(firsts.select("digest", F.col("x.doc_id").alias("id"), "x.row"), "firsts")
    texts = keep_ids(measured, firsts, "row").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "head", "bitmap", "rarest", "light")
    texts = stage.put(texts, "texts")
    stage.drop(measured)
    sets = stage.put(with_keys(texts, boundary(texts, stage, percent), percent), "keys")
    stage.drop(texts)
    exact = _Exact(docs, stage, percent)
    signatures = sets.select("id", F.col("head").alias("sig"))
    components, _ = link(_rows_of_keys(sets), signatures, bound(percent), "<u8", _FAR - 1, exact.verify, lambda mixed: exact.between(mixed, sets), stage)
    return components, spread_join(rows, firsts.select("digest", "id"), ["digest"], "left")


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text).

    ``percent`` is from 80 to 100: below, the subsets of small sets would be too many.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100")
    components, rows = jaccard_links(docs, percent)
    rows = spread_join(rows, components, ["id"], "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component", "id", "doc_id").alias("component_id"))
