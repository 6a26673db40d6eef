"""Token ids in files of Simple-8b words.

Documents are put in ascending order of doc_id (rows that share one: by a hash of the text) by a range shuffle, encoded with the
``tokenizers`` library, ended by an id, and written as blocks of whole documents. A block holds little-endian 64-bit words: the
upper four bits select how many ids of how many bits the other sixty hold. An id of over 60 bits is an escape: selector 0, then a word with
the id itself. Each block has the ids' offset by document, so that it is decoded on its own, all words of a selector at once. The files
are Parquet, one row a block, so any store that Spark writes to will do.

Reading back needs the ids before each block: sums by shard (one task's output) come first, then within a shard. Only sizes are
shuffled for that, never ids.

Defined cases: null and empty texts have only the end id; a null doc_id comes first; repeated rows are each written; extra columns
are ignored; an empty table gives no files' rows and an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondage.llm.common import BROADCAST_IDS, small_batches
from sondage.llm.words import Numbers, span_hashes

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: A block is closed once it holds so many ids.
BLOCK_IDS = 65_536
#: (ids in a word, bits of each) by selector, from 1 on; selector 0 is the escape.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 0
#: Encoded pieces that a task keeps for reuse.
MOST_KEPT = 1_500_000


def pack(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of unsigned ids: each word takes the most ids that fit from its place on."""
    n = len(ids)
    if not n:
        return np.empty(0, "<u8")
    left = n - np.arange(n)
    take, chosen = np.zeros(n, np.int32), np.zeros(n, np.int8)
    widest = int(ids.max()).bit_length()
    near = None
    for selector in range(len(SELECTORS), 0, -1):  # fewest ids first: a later selector that fits takes more
        count, bits = SELECTORS[selector - 1]
        if bits >= widest:
            fits = left >= count
            take[fits], chosen[fits] = count, selector
            continue
        # What fits a selector fits all that take fewer ids of more bits.
        large = np.zeros(n + 1, np.int32)
        np.cumsum(ids >> ids.dtype.type(bits) != 0, out=large[1:])
        near = np.arange(n - count + 1) if near is None else near[near <= n - count]
        near = near[large[near + count] == large[near]]
        if not len(near):
            break
        take[near], chosen[near] = count, selector
    step = np.maximum(take, 1).astype(np.uint8).tobytes()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    ids = ids.astype(np.uint64)
    starts = np.array(starts)
    kinds = chosen[starts]
    slot = np.arange(len(starts)) + np.cumsum(kinds == ESCAPE) - (kinds == ESCAPE)
    out = np.zeros(len(starts) + int((kinds == ESCAPE).sum()), np.uint64)
    for selector, (count, bits) in enumerate(SELECTORS, 1):
        own = np.flatnonzero(kinds == selector)
        if len(own):
            word = np.full(len(own), selector << 60, np.uint64)
            for i in range(count):
                word |= ids[starts[own] + i] << np.uint64(i * bits)
            out[slot[own]] = word
    own = np.flatnonzero(kinds == ESCAPE)
    out[slot[own] + 1] = ids[starts[own]]
    return out.astype("<u8")


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of Simple-8b words, by selector."""
    words = np.asarray(words, np.uint64)
    kinds = (words >> np.uint64(60)).astype(np.int64)
    skip = np.zeros(len(words), bool)
    for at in np.flatnonzero(kinds == ESCAPE):  # an escaped id may look like an escape itself
        if not skip[at] and at + 1 < len(words):
            skip[at + 1] = True
    kinds[skip] = ESCAPE
    counts = np.array([1] + [c for c, _ in SELECTORS])[kinds]
    counts[skip] = 0
    ends = np.cumsum(counts)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint64)
    for selector, (count, bits) in enumerate(SELECTORS, 1):
        own = np.flatnonzero((kinds == selector) & ~skip)
        mask = np.uint64((1 << bits) - 1)
        for i in range(count if len(own) else 0):
            out[ends[own] - count + i] = (words[own] >> np.uint64(i * bits)) & mask
    own = np.flatnonzero((kinds == ESCAPE) & ~skip)
    out[ends[own] - 1] = words[own + 1] if len(own) else 0
    return out


#: The character that stands for each byte in byte-level tokens: printable bytes for themselves, the others from 256 on. A line feed is left as it is, to part words.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_AS_LETTER = np.zeros(256, "<u4")
_AS_LETTER[_PRINTABLE] = _PRINTABLE
_AS_LETTER[[b for b in range(256) if b not in _PRINTABLE]] = np.arange(256, 256 + 256 - len(_PRINTABLE))
_AS_LETTER[10] = 10

#: 1: white space, 2: a full stop or comma; pieces start with these bytes.
_STARTS = np.zeros(256, np.int8)
_STARTS[[32, 10]] = 1
_STARTS[[44, 46]] = 2


class Encoder:
    """Ids of texts by the library, reusing the ids of pieces that come again.

    Texts are cut before spaces, line feeds, full stops and commas. The library splits a text there in any case if the character before
    isn't white space, or before a full stop or comma is a letter or digit; then a text's ids are those of its pieces. A text in which
    a cut isn't of this kind is encoded whole, and so is one that holds a special token's string. Pieces are known by two 64-bit hashes.
    """

    def __init__(self, path: str, most_kept: int = MOST_KEPT) -> None:
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        # Texts that hold such a token's string are encoded whole, as the library cuts them there first.
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        # The same merges for words that are known not to be split before them.
        self.merges = tokenizers.Tokenizer(self.tokenizer.model)
        vocabulary = self.tokenizer.get_vocab()
        # Each character of a byte-level token stands for one byte.
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.size[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.most_kept = most_kept
        self._clear()

    def _clear(self) -> None:
        self.known, self.check = Numbers(), np.empty(0, np.uint64)
        self.ids = np.empty(0, np.uint32)
        self.start, self.length, self.after = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int8)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _words(self, words: list[str]) -> np.ndarray:
        """Ids of pieces that are a space and letters, one after another: no split falls into such a piece."""
        if not words:
            return np.empty(0, np.uint32)
        raw = np.frombuffer("\n".join(words).encode(), np.uint8)
        letters = _AS_LETTER[raw].tobytes().decode("utf-32-le").split("\n")
        return np.array(self.merges.encode_batch_fast([letters], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, fresh: list[str]) -> None:
        """Encodes new pieces. Ids of several pieces are parted by the sizes of their tokens."""
        before = np.array([x[0] in " \n" for x in fresh])
        # 1: ends with white space, 3: with another character that is neither letter nor digit, 0: with one of these.
        after = np.array([0 if x[-1].isalnum() else 1 if x[-1].isspace() else 3 for x in fresh], np.int8)
        word = np.array([x[0] == " " and x[1:].isalpha() for x in fresh])
        start, length = np.empty(len(fresh), np.int64), np.empty(len(fresh), np.int32)
        at, found = len(self.ids), [self.ids]
        # Words; other pieces that start with white space and end with a letter or digit, which stay apart when joined; the rest.
        for kind, encode in ((word, self._words), (~word & before & (after == 0), lambda x: self._whole("".join(x)))):
            held = [fresh[i] for i in np.flatnonzero(kind).tolist()]
            ids = encode(held)
            ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(x.encode()) for x in held])) + 1
            length[kind] = np.diff(ends, prepend=0)
            start[kind] = at + ends - length[kind]
            at += len(ids)
            found.append(ids)
        kind = ~word & ~(before & (after == 0))
        rest = self.tokenizer.encode_batch_fast([fresh[i] for i in np.flatnonzero(kind).tolist()], add_special_tokens=False)
        found += [np.array(x.ids, np.uint32) for x in rest]
        length[kind] = [len(x.ids) for x in rest]
        start[kind] = at + np.cumsum(length[kind]) - length[kind]
        self.ids = np.concatenate(found)
        self.start, self.length = np.concatenate([self.start, start]), np.concatenate([self.length, length])
        self.after = np.concatenate([self.after, after])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text, given in UTF-8."""
        if self.known.count > self.most_kept:
            self._clear()
        raw = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.cumsum([0, *map(len, texts)])
        kind = _STARTS[raw]
        first = np.zeros(len(raw) + 1, bool)
        first[begin] = True
        start = np.flatnonzero((kind > 0) | first[:-1])
        end = np.append(start[1:], len(raw)) if len(start) else start
        hashes, check = span_hashes(raw, start, end, (1, 2))
        hashes |= np.uint64(1)
        number = self.known.find(hashes)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            new = missing[np.unique(hashes[missing], return_index=True)[1]]
            self.known.add(hashes[new])
            self.check = np.concatenate([self.check, check[new]])
            held = raw.tobytes()
            self._learn([held[a:b].decode() for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
            number[missing] = self.known.find(hashes[missing])
        before, after = np.where(first[start], 0, kind[start]), self.after[number]
        wrong = np.flatnonzero(((before[1:] == 1) & (after[:-1] == 1)) | ((before[1:] == 2) & (after[:-1] > 0)))
        length = self.length[number].astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(length)))
        flat = self.ids[np.repeat(self.start[number] - ends[:-1], length) + np.arange(ends[-1])]
        at = ends[np.searchsorted(start, begin)]
        out = [flat[a:b] for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
        wrong = np.concatenate([wrong, np.flatnonzero(self.check[number] != check)])
        whole = set((np.searchsorted(begin, start[wrong], "right") - 1).tolist())
        whole |= {i for i, x in enumerate(texts) if any(t in x for t in self.special)}
        for i in whole:
            out[i] = self._whole(texts[i].decode())
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of ``docs`` (doc_id, text) as blocks below ``folder``."""
    schema = "shard int, block int, doc_ids array<long>, offsets array<int>, n_ids long, words binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, block = encoder(path or public_tokenizers.path(TOKENIZER)), TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint32)
        held: list[np.ndarray] = []
        owners: list[int | None] = []
        offsets = [0]

        def made() -> pa.RecordBatch:
            words = pack(np.concatenate(held))
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "doc_ids": pa.array([owners], pa.list_(pa.int64())), "offsets": pa.array([offsets], pa.list_(pa.int32())), "n_ids": pa.array([offsets[-1]], pa.int64()), "words": pa.array([words.tobytes()], pa.binary())})

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column("text")]
                for own, ids in zip(part.column("doc_id").to_pylist(), coder.encode(texts), strict=True):
                    held += (ids, end)
                    owners.append(own)
                    offsets.append(offsets[-1] + len(ids) + 1)
                    if offsets[-1] >= block_ids:
                        yield made()
                        block += 1
                        held, owners, offsets = [], [], [0]
        if owners:
            yield made()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text")).repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark")
    rows.select("doc_id", "text").mapInArrow(encode, schema).write.option("compression", "zstd").parquet(folder)


def _starts(blocks: DataFrame) -> DataFrame:
    """(shard, block, before): the ids of all blocks before each. One row a shard is all that meets in one place."""
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    within = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")
    return blocks.select("shard", "block", within.alias("inside")).join(shards, "shard").select("shard", "block", (F.col("base") + F.col("inside")).alias("before"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of each document in the files: ids as little-endian unsigned 32-bit integers."""
    small_batches(spark)
    blocks = spark.read.parquet(folder)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = unpack(np.frombuffer(batch.column("words")[i].as_buffer(), "<u8")).astype("<u4").tobytes()
                owners, offsets = batch.column("doc_ids")[i].as_py(), batch.column("offsets")[i].as_py()
                n = len(owners)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([batch.column("shard")[i].as_py()] * n, pa.int32()), "block": pa.array([batch.column("block")[i].as_py()] * n, pa.int32()), "doc_id": pa.array(owners, pa.int64()), "offset": pa.array(offsets[:-1], pa.int32()), "ids": pa.array([ids[4 * a : 4 * b] for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary())})

    rows = blocks.select("shard", "block", "doc_ids", "offsets", "words").mapInArrow(decode, "shard int, block int, doc_id long, offset int, ids binary")
    starts = _starts(blocks.select("shard", "block", "n_ids"))
    # 16 bytes a block; beyond the checked count the join shuffles.
    return rows.join(F.broadcast(starts) if blocks.count() <= BROADCAST_IDS else starts, ["shard", "block"]).select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "ids")


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the rows of ``read``."""
    return rows.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
