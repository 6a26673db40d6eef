"""All pairs of points, compared in blocks: a task holds a few blocks and every other block is read past them.

A block is one row, its points as bytes. The held blocks are dealt to the tasks once and the others are read by each task, so what is shuffled and written grows with the points, while reading
and arithmetic grow with their pairs. A task has its own blocks and one other at a time, and gives what it found about its own points at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.sources.staging import Staging, small_batches

#: Most points of a block, and most bytes of their coordinates.
BLOCK, BLOCK_BYTES = 8192, 1 << 20
#: Most blocks that a task holds, and tasks a core.
HELD, WAVES = 8, 3
#: Rows and columns of the distances that are worked out at once; they stay in a core's cache.
TILE = 128, 512

Block = dict[str, np.ndarray]


def packed(points: DataFrame, stage: Staging, values: list[str], most: int = BLOCK) -> DataFrame:
    """(block, x, values...) of points (x, values...): a row holds the doubles ``x`` and the longs ``values`` of a block's points as bytes. There is at least one point."""
    dims, tasks = len(points.select("x").first().x), points.sparkSession.sparkContext.defaultParallelism
    n = points.count()
    blocks = -(-n // max(1, min(most, BLOCK_BYTES // (8 * max(dims, 1)), -(-n // (2 * tasks)))))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        held = {"block": [pdf["block"].iloc[0]], "x": [np.stack(pdf["x"].to_numpy()).astype("<f8").tobytes()]}
        return pd.DataFrame(held | {c: [pdf[c].to_numpy().astype("<i8").tobytes()] for c in values})

    dealt = points.select("x", *values, F.pmod(F.xxhash64("x", *values), F.lit(blocks)).cast("int").alias("block"))
    return stage.put(dealt.groupBy("block").applyInPandas(pack, "block int, x binary" + "".join(f", {c} binary" for c in values)), "blocks")


def compare(held: DataFrame, others: DataFrame, start: Callable[[Block], object], meet: Callable[[object, Block, Block], None], give: Callable[[object, Block], pd.DataFrame], schema: str) -> DataFrame:
    """The rows that ``give`` makes of each block of ``held`` and its state, after ``meet`` has taken it past all blocks of ``others``; ``start`` makes the state."""
    small_batches(held.sparkSession)
    n, tasks = held.count(), held.sparkSession.sparkContext.defaultParallelism
    parts = min(max(n, 1), max(WAVES * tasks, -(-n // HELD)))
    dealt = held.repartitionById(parts, F.pmod("block", F.lit(parts)).cast("int"))
    # The side that is read past the other one is one partition, so that each task meets all of it.
    passing = others.select(*(F.col(c).alias(f"other_{c}") for c in others.columns)).coalesce(1)
    met = passing.hint("shuffle_replicate_nl").crossJoin(dealt)
    own, other = held.columns, others.columns

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks, states, last = {}, {}, None
        for pdf in batches:
            for i, number in enumerate(pdf["block"]):
                if number not in blocks:
                    blocks[number] = _opened({c: pdf[c].iloc[i] for c in own})
                    states[number] = start(blocks[number])
                if last is None or last["block"] != pdf["other_block"].iloc[i]:
                    last = _opened({c: pdf[f"other_{c}"].iloc[i] for c in other})
                meet(states[number], blocks[number], last)
        for number in blocks:
            yield give(states[number], blocks[number])

    return met.mapInPandas(task, schema)


def _opened(row: dict) -> Block:
    found = {c: np.frombuffer(v, "<i8") for c, v in row.items() if c not in ("block", "x")}
    size = len(next(iter(found.values())))
    return found | {"block": row["block"], "x": np.frombuffer(row["x"], "<f8").reshape(size, -1)}


def tiles(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray, float]]:
    """(rows, columns, squared distances, error) of points tile by tile. Distances are off by ``error`` at most, those that are no greater are worked out from the differences. The next tile overwrites the last."""
    middle = x.mean(0)
    a, b = x - middle, y - middle
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    error = 8 * (x.shape[1] + 4) * np.finfo(float).eps * float(aa.max(initial=0) + bb.max(initial=0))
    left = np.column_stack([a, aa, np.ones(len(a))])
    right = np.vstack([-2 * b.T, np.ones(len(b)), bb])
    room = np.empty(TILE[0] * TILE[1])
    for j in range(0, len(y), TILE[1]):
        columns = slice(j, min(j + TILE[1], len(y)))
        side = np.ascontiguousarray(right[:, columns])
        for i in range(0, len(x), TILE[0]):
            rows = slice(i, min(i + TILE[0], len(x)))
            shape = rows.stop - i, columns.stop - j
            d = np.dot(left[rows], side, out=room[: shape[0] * shape[1]].reshape(shape))
            if d.min() <= error:
                r, c = np.nonzero(d <= error)
                d[r, c] = ((x[rows][r] - y[columns][c]) ** 2).sum(1)
            yield rows, columns, d, error


def near(x: np.ndarray, y: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (row, column) within ``eps``, tile by tile; pairs that rounding leaves in doubt are decided by their differences."""
    for rows, columns, d, error in tiles(x, y):
        r, c = np.nonzero(d <= eps * eps + error)
        if not len(r):
            continue
        doubt = np.flatnonzero(d[r, c] > eps * eps - error)
        keep = np.ones(len(r), bool)
        keep[doubt] = ((x[rows][r[doubt]] - y[columns][c[doubt]]) ** 2).sum(1) <= eps * eps
        yield rows.start + r[keep], columns.start + c[keep]
