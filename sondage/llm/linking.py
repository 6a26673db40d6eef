"""Groups of similar items from shared bucket keys, without expanding the pairs of a bucket.

``link`` takes (key, id) rows. Items that share a key may be similar; a cheap comparison of signatures and an
exact check decide. The work goes in two passes:

1. Each bucket proposes a star: its smallest id with each other member. Each item has only its nearest star
   verified at first, so that a group of n near copies costs n exact checks. Components follow from these links.
2. What one component holds needs no more checks. The other pairs from buckets of two whose ends lie in different
   components are verified, and so is each pair of different components inside a mixed bucket that passes the
   signature comparison. Buckets are compared in blocks of ``BLOCK`` members; each pair of blocks is a row group of its
   own, so that a large bucket is spread over many tasks. Only links leave the comparison.

After both passes every pair that shares a key and passes the signature comparison is either verified or inside
one component. There is no cap on buckets, partners or candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm.common import BROADCAST_IDS, Staging

#: Members of a bucket that are compared at once.
BLOCK = 512
#: Pairs of a block that are tested at once, after which what they link needs no more tests.
AT_ONCE = 2048
#: Distances of rows a[i] and b[i] of two arrays of signatures (broadcasting over leading axes).
Distance = Callable[[np.ndarray, np.ndarray], np.ndarray]


def matrix(column: pa.Array, dtype: type) -> np.ndarray:
    """Binary values of equal length as the rows of an array."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1)


def connected_components(edges: DataFrame, stage: Staging) -> DataFrame:
    """(id, component) of each id in ``edges`` (a, b); the component is the smallest id reachable.

    Alternates large-star and small-star steps until the edges stay the same. Each step only takes minima by node
    and joins them back, so a node with very many edges is combined before the shuffle and its join can be split.
    Each round is a written table.
    """
    now = stage.put(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))
        after = stage.put(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        stage.drop(now)
        now = after
        # Done when each node has one edge, and none to a node that has an edge itself: stars around the smallest ids.
        role = now.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("b", F.lit(0), F.lit(1)))
        if role.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty():
            break
    return stage.put(now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()), "components")


def with_distance(pairs: DataFrame, signatures: DataFrame, distance: Distance, dtype: type, most: int) -> DataFrame:
    """(a, b, two, d) of the pairs whose signatures lie at most ``most`` apart."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            d = distance(matrix(x.column("sa"), dtype), matrix(x.column("sb"), dtype))
            near = np.flatnonzero(d <= most)
            yield pa.RecordBatch.from_arrays([*(x.column(c).take(near) for c in ("a", "b", "two")), pa.array(d[near].astype(np.int32))], ["a", "b", "two", "d"])

    left = signatures.select(F.col("id").alias("a"), F.col("sig").alias("sa"))
    right = signatures.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(compare, "a long, b long, two boolean, d int")


def in_blocks(rows: DataFrame) -> DataFrame:
    """The members of buckets, (key, n, id, ...), once for each pair of blocks (i, j) that their own block is in.

    A bucket of up to ``BLOCK`` members is one block.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *(c for c in rows.columns if c not in ("key", "n", "own", "other")))


def each_block_pair(rows: DataFrame, work: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``work`` on all rows of each (key, i, j). A task holds one such group at a time, besides a batch."""
    return all_block_pairs(rows, lambda groups: map(work, groups), schema)


def all_block_pairs(rows: DataFrame, work: Callable[[Iterator[pa.Table]], Iterator[pa.RecordBatch | None]], schema: str) -> DataFrame:
    """``work`` on the groups of a task, each with all rows of its (key, i, j)."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []

        def cuts(x: pa.Table) -> list[int]:
            key, i, j = (x.column(c).to_numpy() for c in ("key", "i", "j"))
            return (np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist()

        def parts(x: pa.Table, at: list[int]) -> Iterator[pa.Table]:
            for lo, hi in zip(at, at[1:], strict=False):
                if hi - lo > 1:
                    yield x.slice(lo, hi - lo).combine_chunks()

        for batch in batches:
            held.append(batch)
            x = pa.Table.from_batches(held)
            if at := cuts(x):
                yield from parts(x, [0, *at])
                held = x.slice(at[-1]).combine_chunks().to_batches()
        if held and (x := pa.Table.from_batches(held)).num_rows:
            yield from parts(x, [0, *cuts(x), x.num_rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in work(groups(batches)):
            if got is not None and got.num_rows:
                yield got

    return rows.repartition(F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("key", "i", "j").mapInArrow(run, schema)


def near_in_block(x: pa.Table, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, later rows near it) of different components; of two blocks, only pairs across. Memory stays at one row against a block."""
    group, own = (x.column(c).to_numpy() for c in ("component", "own"))
    i, j = x.column("i")[0].as_py(), x.column("j")[0].as_py()
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    for at in left.tolist():
        others = right[right > at] if i == j else right
        others = others[group[others] != group[at]]
        if len(others) and len(others := others[near(at, others)]):
            yield at, others


Nearby = Callable[[pa.Table], Iterator[tuple[int, np.ndarray]]]
Test = Callable[[np.ndarray, np.ndarray], np.ndarray]


def links_across(rows: DataFrame, light: DataFrame, heavy: Callable[[DataFrame], DataFrame], nearby: Nearby, alike: Callable[[list[pa.Buffer]], Test], stage: Staging, at_once: int = AT_ONCE, together: int = 0) -> DataFrame:
    """The links (a, b) of different components inside the mixed buckets of ``rows`` (key, n, id, component).

    First the members with a near partner are found by their signatures, ``light`` (id, sig) and ``nearby``; then what ``heavy`` gives for
    their ids, (id, held), is compared by ``alike``: of all that a block holds it makes a test of pairs, many at a time. What gets linked in a block needs no more links there, so links are few.
    With ``together``, blocks that hold so many bytes have their next pairs compared at once, for tests that cost less a pair when they have many.
    """

    def candidates(x: pa.Table) -> pa.RecordBatch | None:
        wanted = np.zeros(x.num_rows, bool)
        for at, others in nearby(x):
            wanted[at] = True
            wanted[others] = True
        return x.select(["key", "i", "j", "own", "id", "component", "sig"]).filter(pa.array(wanted)).combine_chunks().to_batches()[0] if wanted.any() else None

    spread = in_blocks(rows.join(light, "id"))
    found = stage.put(each_block_pair(spread, candidates, "key long, i int, j int, own int, id long, component long, sig binary"), "near")
    held = found.join(heavy(found.select("id").distinct()), "id")
    if together:
        return all_block_pairs(held, lambda blocks: linked(blocks, nearby, alike, at_once, together), "a long, b long")
    return each_block_pair(held, lambda x: _linked_alone(x, nearby, alike, at_once), "a long, b long")


def _linked_alone(x: pa.Table, nearby: Nearby, alike: Callable[[list[pa.Buffer]], Test], at_once: int) -> pa.RecordBatch | None:
    """The links inside a block, by one test of all that it holds."""
    work, test = _steps(x, nearby, at_once), alike([v.as_buffer() for v in x.column("held")])
    try:
        pairs = next(work)
        while True:
            pairs = work.send(test(*pairs))
    except StopIteration as end:
        return end.value


def linked(blocks: Iterator[pa.Table], nearby: Nearby, alike: Callable[[list[pa.Buffer]], Test], at_once: int, together: int) -> Iterator[pa.RecordBatch | None]:
    """The links inside each block (id, component, held), by tests of the next pairs of several blocks. A block is begun while those under way hold less than ``together`` bytes."""
    # Of each block under way: its steps, what its rows hold, its bytes, and the pairs that wait.
    running: list[tuple] = []
    size, ended = 0, False
    while running or not ended:
        while not ended and (not running or size < together):
            if (x := next(blocks, None)) is None:
                ended = True
                break
            work, held = _steps(x, nearby, at_once), [v.as_buffer() for v in x.column("held")]
            try:
                running.append((work, held, x.nbytes, next(work)))
                size += x.nbytes
            except StopIteration as end:
                yield end.value
        if not running:
            continue
        left = []
        for (work, held, own, _), near in zip(running, _tested(alike, [(held, *pairs) for _, held, _, pairs in running]), strict=True):
            try:
                left.append((work, held, own, work.send(near)))
            except StopIteration as end:
                size -= own
                yield end.value
        running = left


def _steps(x: pa.Table, nearby: Nearby, at_once: int) -> Generator[tuple[np.ndarray, np.ndarray], np.ndarray, pa.RecordBatch | None]:
    """Gives pairs of rows of a block and takes which of them are links; ends with the links found."""
    ids = x.column("id").to_numpy()
    names, group = np.unique(x.column("component").to_numpy(), return_inverse=True)
    root = np.arange(len(names))
    found, waiting, count = [], [], 0

    def settle() -> Generator[tuple[np.ndarray, np.ndarray], np.ndarray, None]:
        if not waiting:
            return
        a, b = (np.concatenate(x) for x in zip(*waiting, strict=True))
        waiting.clear()
        apart = root[group[a]] != root[group[b]]
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        near = yield a, b
        for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
            if root[group[x]] != root[group[y]]:
                root[root == root[group[y]]] = root[group[x]]
                found.append((ids[x], ids[y]))

    for at, others in nearby(x):
        waiting.append((np.full(len(others), at), others))
        count += len(others)
        if count >= at_once:
            yield from settle()
            count = 0
    yield from settle()
    if not found:
        return None
    a, b = np.array(found).T
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _tested(alike: Callable[[list[pa.Buffer]], Test], asked: list[tuple[list[pa.Buffer], np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
    """Which pairs are links, for each (held, a, b), by one test of what all these pairs hold."""
    used, left, right = [], [], []
    for held, a, b in asked:
        rows, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        left.append(len(used) + place[: len(a)])
        right.append(len(used) + place[len(a) :])
        used += [held[i] for i in rows.tolist()]
    near = alike(used)(np.concatenate(left), np.concatenate(right))
    return iter(np.split(near, np.cumsum([len(x) for x in left])[:-1]))


def link(keys: DataFrame, signatures: DataFrame, distance: Distance, dtype: type, most: int, verify: Callable[[DataFrame], DataFrame], across: Callable[[DataFrame], DataFrame], stage: Staging) -> tuple[DataFrame, DataFrame]:
    """(components, verified links) of the items.

    keys: (key, id), each once. signatures: (id, sig). verify: from (a, b) those that are links. across: the links
    inside mixed buckets (key, n, id, component), by ``links_across``. Items without a link are in no row of the components.
    """
    buckets = stage.put(keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("n > 1 and lo < hi"), "buckets")
    large = buckets.where("n > 2").select("key", "lo", "n")
    members = stage.put(keys.join(F.broadcast(large) if large.count() <= BROADCAST_IDS // 2 else large, "key"), "members")
    two = buckets.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"), F.lit(True).alias("two"))
    star = two.union(members.where("id <> lo").select("lo", "id", F.lit(False))).groupBy("a", "b").agg(F.bool_or("two").alias("two"))
    star = stage.put(with_distance(star, signatures, distance, dtype, most), "star")
    first = star.groupBy("b").agg(F.min(F.struct("d", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    links = stage.put(verify(first).distinct(), "links")
    found = connected_components(links, stage)

    def labelled(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.join(found.select(F.col("id").alias(column), F.col("component").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))

    # What only a bucket of two proposes; other stars are pairs of a mixed bucket.
    apart = labelled(labelled(star.where("two").select("a", "b"), "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")
    labels = stage.put(labelled(members.select("key", "n", "id"), "id", "component"), "labels")
    mixed = labels.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    rows = labels.join(mixed, "key")
    more = verify(apart.join(first, ["a", "b"], "left_anti")).union(across(rows))
    more = stage.put(more.distinct(), "links")
    # Only components are joined now, so the graph is that of the components.
    between = labelled(labelled(more, "a", "ca"), "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    joined = connected_components(between, stage)
    moved = found.join(joined.select(F.col("id").alias("component"), F.col("component").alias("now")), "component", "left").select("id", F.coalesce("now", "component").alias("component"))
    return stage.put(moved.union(joined.join(found, "id", "left_anti")), "components"), links.union(more)
