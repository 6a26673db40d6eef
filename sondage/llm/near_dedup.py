"""MinHash near-duplicate documents by a multi-index Hamming join of b-bit signatures.

A document's set holds its distinct shingles of five words, A-Z lower-cased; one of fewer words has its whole
word sequence as the only shingle; one without words has none and is linked with nothing. Two documents are
linked if 100 * intersection >= 75 * union of their full sets.

The signature has 60 positions of 16 bits, the low bits of as many MinHash values; the distance is the count of
positions that differ. It is cut into 12 chunks of 5 positions. Two signatures at most 23 apart have, by
pigeonhole, a chunk with at most one position that differs, so each chunk is looked up under its five ways to
leave one position out: 60 keys a document, and no pair within the threshold is missed. Pairs at 0.75 similarity
differ in 15 positions on average (23 or fewer for 99 in 100); those further apart still meet when a chunk has
few errors by chance, so that one in 150,000 pairs at exactly 0.75 shares no key. Pairs over 30 apart are not verified.

Inside buckets of several components, pairs are compared by long signatures of 240 positions; only links leave these
comparisons, so a large group of texts just below the threshold costs comparisons, not rows.

Equal sets are collapsed beforehand, so copies cost no comparison.

Defined cases: null or blank text has an empty set; rows that share a doc_id are one document; a null doc_id has
a null component and is kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm.common import Staging, keep_ids, small_batches
from sondage.llm.linking import link, links_across, matrix, near_in_block
from sondage.llm.words import mix, shingle_sets

CHUNKS, WIDTH = 12, 5
POSITIONS = CHUNKS * WIDTH
#: Pairs of signatures up to here are guaranteed to share a key.
GUARANTEED = 2 * CHUNKS - 1
#: Pairs of signatures beyond here are not verified.
FARTHEST = 30
#: Positions that long signatures have besides, and the distance of long signatures beyond which pairs aren't verified: 4.5 standard deviations from the mean at 0.75.
MORE, FARTHEST_LONG = 180, 90

_random = np.random.default_rng(20240607)
_FLIP = _random.integers(0, 2**63, POSITIONS, dtype=np.uint64)
_TIMES = _random.integers(0, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP_MORE = _random.integers(0, 2**63, MORE, dtype=np.uint64)
_TIMES_MORE = _random.integers(0, 2**63, MORE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEY = _random.integers(0, 2**63, POSITIONS, dtype=np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The low 16 bits of the MinHash under each of the 60 functions; ``hashes`` is not empty."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        np.minimum(least, ((part[None, :] ^ _FLIP[:, None]) * _TIMES[:, None]).min(axis=1), out=least)
    return (mix(least) & np.uint64(0xFFFF)).astype("<u2")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=-1)


def signature_keys(signatures: np.ndarray) -> np.ndarray:
    """60 keys for each row: the chunk, the position that is left out, and the values of the other four."""
    out = np.empty((len(signatures), POSITIONS), np.uint64)
    for at in range(POSITIONS):
        chunk, gone = divmod(at, WIDTH)
        held = [chunk * WIDTH + i for i in range(WIDTH) if i != gone]
        out[:, at] = mix(np.ascontiguousarray(signatures[:, held]).view("<u8").ravel() ^ _KEY[at])
    return out


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, sig) of each row; digest and sig are null for an empty set."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, digest, sig = [], [], []
            for hashes, _ in shingle_sets(x.as_buffer() and x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column("text")):
                count.append(len(hashes))
                digest.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
                sig.append(signature(hashes).tobytes() if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "digest", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(measure, "doc_id long, n_shingles long, digest binary, sig binary")


def _keys(signatures: DataFrame) -> DataFrame:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                keys = signature_keys(matrix(x.column("sig"), "<u2"))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(x.column("id").to_numpy(), POSITIONS))], ["key", "id"])

    return signatures.mapInArrow(spread, "key long, id long")


def long_signature(hashes: np.ndarray) -> np.ndarray:
    """The signature's bytes, then the low 8 bits of ``MORE`` further MinHash values."""
    least = np.full(MORE, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        np.minimum(least, ((part[None, :] ^ _FLIP_MORE[:, None]) * _TIMES_MORE[:, None]).min(axis=1), out=least)
    return np.concatenate((signature(hashes).view(np.uint8), (mix(least) & np.uint64(0xFF)).astype(np.uint8)))


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct hashes."""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(few) < percent * len(many):
        return False
    where = np.searchsorted(many, few)
    where[where == len(many)] = 0
    both = int((many[where] == few).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class _Exact:
    """Checks on full sets, which are worked out anew from the texts of the documents in question."""

    def __init__(self, docs: DataFrame, stage: Staging, percent: int) -> None:
        self.texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
        self.stage, self.percent = stage, percent

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, held, long) of the documents: the set and the long signature."""

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                found = [hashes for hashes, _ in shingle_sets(x.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([x.column("id"), pa.array([h.tobytes() for h in found], pa.binary()), pa.array([long_signature(h).tobytes() for h in found], pa.binary())], ["id", "held", "long"])

        return self.stage.put(keep_ids(self.texts, ids, "id").mapInArrow(sets, "id long, held binary, long binary"), "sets")

    def verify(self, pairs: DataFrame) -> DataFrame:
        percent = self.percent

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                held = [[np.frombuffer(v.as_buffer(), np.uint64) for v in x.column(c)] for c in ("ha", "hb")]
                right = [i for i, (a, b) in enumerate(zip(*held, strict=True)) if alike(a, b, percent)]
                yield x.select(["a", "b"]).take(pa.array(right, pa.int64()))

        pairs = self.stage.put(pairs.select("a", "b"), "pairs")
        held = self.sets(pairs.select("a").union(pairs.select("b")).toDF("id").distinct())
        left, right = (held.select(F.col("id").alias(c), F.col("held").alias(f"h{c}")) for c in "ab")
        links = self.stage.put(pairs.join(left, "a").join(right, "b").mapInArrow(compare, "a long, b long"), "verified")
        self.stage.drop(held)
        return links

    def across(self, rows: DataFrame) -> DataFrame:
        """The links of different components inside mixed buckets.

        Partners are near by long signatures. A pair is compared in the first bucket that it shares only.
        """
        rows = self.stage.put(rows, "mixed")
        held = self.sets(rows.select("id").distinct())

        def nearby(x: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
            sig = matrix(x.column("sig").combine_chunks(), np.uint8)
            short, more = np.ascontiguousarray(sig[:, : 2 * POSITIONS]).view("<u2"), sig[:, 2 * POSITIONS :]
            which = int(np.flatnonzero(signature_keys(short[:1])[0].view(np.int64) == x.column("key")[0].as_py())[0])
            chunk, gone = divmod(which, WIDTH)

            def near(at: int, others: np.ndarray) -> np.ndarray:
                same = short[others] == short[at]
                found = (~same).sum(axis=1) + (more[others] != more[at]).sum(axis=1) <= FARTHEST_LONG
                errors = WIDTH - same[:, : (chunk + 1) * WIDTH].reshape(len(others), chunk + 1, WIDTH).sum(axis=2)
                # No earlier chunk shares a key. In this one, a pair without errors belongs to the first position.
                return found & (errors[:, :chunk] > 1).all(axis=1) & ((errors[:, chunk] == 1) | (gone == 0))

            return near_in_block(x, near)

        percent = self.percent
        held = held.select("id", "held", F.col("long").alias("sig"))

        def test(found: list[pa.Buffer]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
            sets = [np.frombuffer(x, np.uint64) for x in found]
            return lambda a, b: np.array([alike(sets[x], sets[y], percent) for x, y in zip(a.tolist(), b.tolist(), strict=True)], bool)

        return links_across(rows, held.select("id", "sig"), lambda ids: held.select("id", "held"), nearby, test, self.stage)


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text).

    ``percent`` is the least similarity, 75 or more: the signature thresholds are set for 75.
    """
    if not 75 <= percent <= 100:
        raise ValueError("percent must be from 75 to 100: the signatures are made for 75")
    stage = Staging(docs.sparkSession, "near")
    small_batches(docs.sparkSession)
    rows = stage.put(features(docs), "features")
    texts = stage.put(rows.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "sig")).alias("x")).select("digest", F.col("x.doc_id").alias("id"), F.col("x.sig").alias("sig")), "texts")
    signatures = texts.select("id", "sig")
    exact = _Exact(docs, stage, percent)
    components, _ = link(_keys(signatures), signatures, distance, "<u2", FARTHEST, exact.verify, exact.across, stage)
    # A doc_id whose rows hold different texts connects them, as its rows are one document.
    own = texts.select("digest", "id").join(components, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    rows = rows.select("doc_id", "n_shingles", "digest").join(own, "digest", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The documents that are the first of their group, with all columns."""
    gone = near_duplicates(docs, percent).where("not kept").select("doc_id").distinct()
    return keep_ids(docs, gone, "doc_id", "left_anti")
