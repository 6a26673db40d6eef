"""Merkle manifest of a dataset: a leaf for each document, a tree for each source, a tree over the sources, and each document's proof.

A leaf is the SHA-256 of doc_id, source, lang, n_chars and text, each as ``-`` if null, else its count of UTF-8 bytes, ``:`` and the value. The leaves of a source ascend by doc_id (null
first); while several nodes remain, each 16 consecutive ones (the last run may be shorter, even of one) become the SHA-256 of their digests as hexadecimal text. What remains is
the source's root; the roots of all sources, in byte order (null first), give the root of the dataset likewise. A proof holds, for each level on the way up, the
digests of its run before and after the own node.

Places are counted over ranges: rows are dealt by (source, doc_id) and sorted, and the counts of the ranges before are added. 4,096 consecutive places are an aligned block, whose three levels are worked out in one
task; the digests on top of the blocks are the leaves of the next layer. So a hot source is many blocks, and each layer has 4,096 times fewer rows than the one below.
Proofs go from the top down. A block's upper proof comes in as one row before its nodes. The block is traversed fractally: of each level a task keeps the existing subtree, the run that the current path goes through, and the
desired one, the next run, which grows by 16 leaves while 16 paths are emitted and is ready when the path enters it; so besides the digests of one block it keeps two runs and a stack of each level.

Defined cases: a null or empty text is hashed as such (``-`` and ``0:``); rows that share a source and doc_id are ordered by their digests, so equal rows have leaves of their own, and which of them has
which place is arbitrary; a null doc_id comes first; other columns are ignored; an empty table gives an empty result. ``doc_id`` and ``n_chars`` are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.llm.common import BROADCAST_IDS, Staging, small_batches

FAN, BITS = 16, 4
#: Levels of a block, and its leaves.
LEVELS = 3
SPAN = FAN**LEVELS
#: Rows that are handed on at once, of some kilobytes each.
AT_ONCE = 512

_STEP = pa.struct([("before", pa.string()), ("after", pa.string())])
_PROOF = "array<struct<before: string, after: string>>"


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """The leaf as hexadecimal text."""
    values = [doc_id.cast("long").cast("string"), source.cast("string"), lang.cast("string"), n_chars.cast("long").cast("string"), text.cast("string")]
    fields = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in values]
    return F.sha2(F.concat(*fields).cast("binary"), 256)


def proof_text(proof: Column) -> Column:
    """The digests of a proof on end."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), "")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` leads to by ``proof``."""
    return F.aggregate(proof, leaf, lambda own, step: F.sha2(F.concat(step["before"], own, step["after"]).cast("binary"), 256))


def digest_of(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def top(nodes: list[str], levels: int | None) -> str:
    """What remains of a block's nodes after so many levels, and of a whole tree (None) where one remains."""
    while len(nodes) > 1 if levels is None else levels > 0:
        nodes = [digest_of(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
        levels = levels and levels - 1
    return nodes[0]


class Subtree:
    """The run of up to 16 nodes of one level over the leaves from ``at`` on. It grows by 16 leaves at a time, with those nodes at hand whose runs aren't complete."""

    def __init__(self, leaves: list[str], level: int, at: int) -> None:
        self.leaves, self.level, self.at, self.end = leaves, level, at, min(at + FAN ** (level + 1), len(leaves))
        self.stack: list[list[str]] = [[] for _ in range(level + 1)]

    @property
    def nodes(self) -> list[str]:
        return self.stack[self.level]

    def grow(self) -> None:
        if self.at >= self.end:
            return
        self.stack[0] += self.leaves[self.at : self.at + FAN]
        self.at += FAN
        for i in range(self.level):
            if len(self.stack[i]) == FAN or self.at >= self.end and self.stack[i]:
                self.stack[i + 1].append(digest_of(self.stack[i]))
                self.stack[i] = []

    def grown(self) -> Subtree:
        while self.at < self.end:
            self.grow()
        return self


def traversal(leaves: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """The path of each leaf in turn: the digests before and after the own node, of each of so many levels."""
    existing = [Subtree(leaves, i, 0).grown() for i in range(levels)]
    desired = [Subtree(leaves, i, FAN ** (i + 1)) for i in range(levels)]
    above: list[tuple[str, str]] = []
    for j in range(len(leaves)):
        if j % FAN == 0:  # The levels above the leaves stay the same for a run of them.
            above = [_around(existing[i].nodes, j >> BITS * i & FAN - 1) for i in range(1, levels)]
        yield [*(_around(x.nodes, j & FAN - 1) for x in existing[:1]), *above]
        if (j + 1) % FAN == 0:
            for x in desired:
                x.grow()
            for i in range(levels):
                if (j + 1) % FAN ** (i + 1) == 0:
                    existing[i], desired[i] = desired[i], Subtree(leaves, i, j + 1 + FAN ** (i + 1))


def _around(nodes: list[str], at: int) -> tuple[str, str]:
    return "".join(nodes[:at]), "".join(nodes[at + 1 :])


def numbered(rows: DataFrame, order: list[str], stage: Staging) -> DataFrame:
    """``rows`` (key, ...) with ``pos``, the place in ``order`` among the rows of the key, and ``total``, their count."""
    # Equal rows are told apart, so that they can be in different ranges.
    rows = rows.withColumn("own", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("key", *order, "own").sortWithinPartitions("key", *order, "own").drop("own")
    rows = stage.put(rows.withColumns({"part": F.spark_partition_id(), "n": F.monotonically_increasing_id()}), "sorted")
    parts = rows.groupBy("key", "part").agg(F.count("*").alias("count"), F.min("n").alias("first"))
    # A key has one row a range.
    own = Window.partitionBy("key")
    parts = parts.withColumns({"before": F.sum("count").over(own.orderBy("part")) - F.col("count"), "total": F.sum("count").over(own)})
    parts = stage.put(parts.select("key", "part", (F.col("before") - F.col("first")).alias("shift"), "total"), "ranges")
    joined = rows.join(F.broadcast(parts) if parts.count() <= BROADCAST_IDS // 4 else parts, ["key", "part"])
    return joined.withColumn("pos", F.col("shift") + F.col("n")).drop("part", "n", "shift")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (key, block), of batches that are sorted by them. One is held at a time, besides a batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key, block = batch.column("key").to_pylist(), batch.column("block").to_pylist()
        at = 0
        for i in range(batch.num_rows):
            before = (key[i - 1], block[i - 1]) if i else (held[-1].column("key")[-1].as_py(), held[-1].column("block")[-1].as_py()) if held else None
            if before not in (None, (key[i], block[i])):
                yield pa.Table.from_batches([*held, batch.slice(at, i - at)])
                held, at = [], i
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "pos")


def _tops(nodes: DataFrame) -> DataFrame:
    """(key, pos, total, digest) of the blocks of nodes (key, pos, total, digest)."""

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _blocks(batches):
            total = x.column("total")[0].as_py()
            row = x.column("key")[0].as_py(), x.column("block")[0].as_py(), -(-total // SPAN), top(x.column("digest").to_pylist(), None if total <= SPAN else LEVELS)
            yield pa.RecordBatch.from_arrays([pa.array([row[0]]), *(pa.array([v], pa.int64()) for v in row[1:3]), pa.array([row[3]])], ["key", "pos", "total", "digest"])

    rows = nodes.select("key", F.expr(f"pos div {SPAN}").alias("block"), "pos", "total", "digest")
    return _dealt(rows).mapInArrow(tops, "key string, pos long, total long, digest string")


def _paths(nodes: DataFrame, uppers: DataFrame, carry: list[str]) -> DataFrame:
    """(key, pos, digest, subroot, proof, carried...) of nodes (key, pos, total, digest, carried...).

    ``uppers`` has a row (key, pos, subroot, proof) for each block. It comes before the block's nodes.
    """
    schema = {c: nodes.schema[c].dataType for c in carry}
    rows = nodes.select("key", F.expr(f"pos div {SPAN}").alias("block"), "pos", "total", "digest", F.lit(None).cast("string").alias("subroot"), F.lit(None).cast(_PROOF).alias("proof"), *carry)
    heads = uppers.select("key", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("total"), F.lit(None).cast("string").alias("digest"), "subroot", "proof", *(F.lit(None).cast(t).alias(c) for c, t in schema.items()))

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _blocks(batches):
            upper = [(s["before"], s["after"]) for s in x.column("proof")[0].as_py()]
            subroot = x.column("subroot")[0].as_py()
            x = x.slice(1).combine_chunks()
            leaves, total = x.column("digest").to_pylist(), x.column("total")[0].as_py()
            levels, left = (0, total) if total <= SPAN else (LEVELS, 1)
            while left > 1:
                levels, left = levels + 1, -(-left // FAN)
            steps = traversal(leaves, levels)
            for at in range(0, len(leaves), AT_ONCE):
                part = x.slice(at, AT_ONCE).to_batches()[0]
                flat = [s for _, own in zip(range(part.num_rows), steps, strict=False) for s in (*own, *upper)]
                each = levels + len(upper)
                before, after = (pa.array([s[k] for s in flat], pa.string()) for k in (0, 1))
                proof = pa.ListArray.from_arrays(pa.array(range(0, each * part.num_rows + 1, each) if each else [0] * (part.num_rows + 1), pa.int32()), pa.StructArray.from_arrays([before, after], fields=list(_STEP)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("key", "pos", "digest")), pa.array([subroot] * part.num_rows, pa.string()), proof, *(part.column(c) for c in carry)], ["key", "pos", "digest", "subroot", "proof", *carry])

    out = ", ".join(["key string, pos long, digest string, subroot string", f"proof {_PROOF}", *(f"`{c}` {t.simpleString()}" for c, t in schema.items())])
    return _dealt(rows.unionByName(heads)).mapInArrow(paths, out)


class _Forest:
    """The trees of nodes (key, pos, total, digest): one a key, in layers of blocks."""

    def __init__(self, nodes: DataFrame, stage: Staging) -> None:
        self.stage, self.layers, self.tops = stage, [], []
        left = nodes
        while True:
            self.layers.append(left)
            self.tops.append(stage.put(_tops(left), "tops"))
            left = self.tops[-1].where("total > 1")
            if left.isEmpty():
                break

    def roots(self) -> DataFrame:
        """(key, digest) of each tree."""
        out = self.tops[0].where("total = 1")
        for x in self.tops[1:]:
            out = out.union(x.where("total = 1"))
        return out.select("key", "digest")

    def paths(self, uppers: DataFrame, carry: list[str]) -> DataFrame:
        """The paths of all nodes, to which the rows of ``uppers`` (key, subroot, proof) lead on from the roots of the trees."""
        uppers = self.stage.put(uppers, "uppers")
        below = None
        for nodes, tops in reversed(list(zip(self.layers, self.tops, strict=True))):
            ends = uppers.join(tops.where("total = 1").select("key", "pos"), "key").select("key", "pos", "subroot", "proof")
            own = ends if below is None else ends.union(below.select("key", "pos", "subroot", "proof"))
            first = nodes is self.layers[0]
            below = _paths(nodes, own, carry if first else [])
            if not first:
                below = self.stage.put(below, "paths")
        return below


def proofs(docs: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, place, leaf, subroot, root, proof, carried...) of each row of ``docs`` (doc_id, source, lang, n_chars, text).

    ``place`` counts from 0 within the source; ``proof`` leads from the leaf to the root (see ``folded``); ``carry`` names further columns that are worked out from the rows of ``docs``.
    """
    stage = Staging(docs.sparkSession, "merkle")
    small_batches(docs.sparkSession)
    held = {f"carried_{i}": x for i, x in enumerate((carry or {}).values())}
    leaf = leaf_digest(*(docs[c] for c in ("doc_id", "source", "lang", "n_chars", "text")))
    # Null comes before all names, the empty one among them.
    key = F.coalesce(F.concat(F.lit("s"), docs["source"].cast("string")), F.lit(""))
    leaves = stage.put(docs.select(key.alias("key"), docs["doc_id"].cast("long").alias("doc_id"), leaf.alias("digest"), *(x.alias(c) for c, x in held.items())), "leaves")
    sources = _Forest(stage.put(numbered(leaves, ["doc_id", "digest"], stage), "numbered"), stage)
    names = stage.put(numbered(sources.roots().select(F.lit("").alias("key"), F.col("key").alias("source"), "digest"), ["source"], stage), "sources")
    all_ = _Forest(names, stage)
    root = all_.roots().select("digest").first()
    empty = docs.sparkSession.createDataFrame([("", None, [])], f"key string, subroot string, proof {_PROOF}")
    uppers = all_.paths(empty, ["source"]).select(F.col("source").alias("key"), F.col("digest").alias("subroot"), "proof")
    rows = sources.paths(uppers, ["doc_id", *held])
    return rows.select("doc_id", F.col("pos").alias("place"), F.col("digest").alias("leaf"), "subroot", F.lit(root and root[0]).cast("string").alias("root"), "proof", *(F.col(c).alias(name) for c, name in zip(held, carry or {}, strict=True)))


def manifest(docs: DataFrame) -> DataFrame:
    """(source, subroot, root) of the sources of ``docs``."""
    rows = proofs(docs, {"source": docs["source"]})
    return rows.where("place = 0").select("source", "subroot", "root")


def tampered_leaf(docs: DataFrame) -> Column:
    """The leaf of a row whose text has A-Z in lower case."""
    text = docs["text"].cast("string")
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return leaf_digest(docs["doc_id"], docs["source"], docs["lang"], docs["n_chars"], low)


def verified(docs: DataFrame, every: int = 5) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): each leaf is led to the root by its proof; where ``every`` divides the CRC-32 of the doc_id, a tampered leaf."""
    chosen = F.crc32(docs["doc_id"].cast("long").cast("string").cast("binary")) % every == 0
    rows = proofs(docs, {"tampered": F.when(chosen, tampered_leaf(docs))})
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
