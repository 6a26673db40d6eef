"""Benchmark passages inside documents, by size-partitioned bottom-k MinHash containment.

An item is found in a document if the document's set of five-word shingles (A-Z lower-cased) holds at least 75 in
100 of the item's. Items are partitioned by size: those of partition c have 2**(c-1) < q <= 2**c shingles. An item
of q shingles may lose ``q - ceil(0.75 q)`` of them; its sketch is that many and one more of the smallest MinHash
values, so by pigeonhole each document that holds the item holds a sketched shingle, however long the document is.
A partition is skipped for documents with fewer shingles than its smallest item needs. Candidates are verified
by counting all the item's shingles in the document's full set.

Items are taken in blocks of at most about ``BLOCK_SHINGLES`` shingles. A block is sent to all tasks and the documents
are passed over once for each block: documents are neither shuffled nor joined, so no key can be hot.

Defined cases: null and blank texts hold nothing; an item of fewer than five words has its word sequence as its only
shingle, which only a document of the same few words holds; an item without words is found nowhere; repeated
rows are each judged; columns other than the text are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm.common import small_batches
from sondage.llm.words import SHINGLE, Words, mix, shingle_sets, slices

#: Shingles in a block of items; as 8 bytes each, this bounds what is sent to a task.
BLOCK_SHINGLES = 2_000_000


class Items:
    """A block of items with their sketches, by size partition."""

    def __init__(self, ids: list[int], texts: list[bytes], percent: int) -> None:
        self.ids, self.sets, self.need = [], [], []
        sketches: dict[int, list] = {}
        for own, (hashes, _) in zip(ids, shingle_sets(texts), strict=True):
            if not len(hashes):
                continue
            at, need = len(self.ids), -(-percent * len(hashes) // 100)
            self.ids.append(own)
            self.sets.append(hashes)
            self.need.append(need)
            bottom = hashes[np.argsort(mix(hashes), kind="stable")[: len(hashes) - need + 1]]
            sketches.setdefault(int(len(hashes) - 1).bit_length(), []).append((need, bottom, at))
        self.partitions = []
        for part in sketches.values():
            hashes = np.concatenate([bottom for _, bottom, _ in part])
            owner = np.concatenate([np.full(len(bottom), at) for _, bottom, at in part])
            order = np.argsort(hashes, kind="stable")
            self.partitions.append((min(need for need, _, _ in part), hashes[order], owner[order]))

    def found_in(self, hashes: np.ndarray) -> list[tuple[int, int]]:
        """(item, shared shingles) for the sorted distinct ``hashes`` of a document."""
        found = []
        for fewest, sketch, owner in self.partitions:
            if len(hashes) < fewest:
                continue
            where = np.searchsorted(hashes, sketch)
            where[where == len(hashes)] = 0
            found += [(int(at), shared) for at in np.unique(owner[hashes[where] == sketch]) if (shared := self._shared(at, hashes)) >= self.need[at]]
        return found

    def _shared(self, at: int, hashes: np.ndarray) -> int:
        where = np.searchsorted(hashes, self.sets[at])
        where[where == len(hashes)] = 0
        return int((hashes[where] == self.sets[at]).sum())

    def any_of_slice(self, words: Words) -> Iterator[tuple[int, np.ndarray]]:
        """(text, its sorted distinct hashes) for each text of a slice that holds a sketched shingle."""
        hashes, at = words.shingles()
        hit = np.zeros(len(hashes), bool)
        for _, sketch, _ in self.partitions:
            where = np.searchsorted(sketch, hashes)
            where[where == len(sketch)] = 0
            hit |= sketch[where] == hashes
        for i in np.unique(np.searchsorted(at, np.flatnonzero(hit), "right") - 1):
            yield int(i), np.unique(hashes[at[i] : at[i + 1]])


def blocks(items: DataFrame, percent: int = 75) -> Iterator[Items]:
    """The items in blocks of bounded size."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = 1 + size // (BLOCK_SHINGLES * SHINGLE)
    for i in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == i).orderBy("item_id", "text").collect()
        if rows:
            yield Items([r.item_id for r in rows], [bytes(r.text) for r in rows], percent)


def _texts(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes | None]:
    return (x.as_buffer().to_pybytes() if x.is_valid else None for x in column)


def contaminated(docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) for each document row and each item found in it."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    out = spark.createDataFrame([], "doc_id long, item_id long, n_shared long, n_item long")
    for block in blocks(items, percent):
        sent = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for batch in batches:
                rows = []
                for first, held in slices(_texts(batch.column("text"))):
                    for i, hashes in block.any_of_slice(Words(held, lower=True)):
                        rows += [(first + i, block.ids[at], shared, len(block.sets[at])) for at, shared in block.found_in(hashes)]
                index, item, shared, size = zip(*rows, strict=True) if rows else ((),) * 4
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(index, pa.int64())), *(pa.array(x, pa.int64()) for x in (item, shared, size))], ["doc_id", "item_id", "n_shared", "n_item"])

        out = out.union(source.mapInArrow(search, out.schema))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """The document rows in which no item is found, with all columns."""
    spark, schema = docs.sparkSession, docs.schema
    small_batches(spark)
    for block in blocks(items, percent):
        sent = spark.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for first, held in slices(_texts(batch.column("text").cast(pa.binary()))):
                    for i, hashes in block.any_of_slice(Words(held, lower=True)):
                        keep[first + i] = not block.found_in(hashes)
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, schema)
    return docs
