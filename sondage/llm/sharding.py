"""Shards by extendible hashing, with DataFrame operations only.

The hash of a row is the first 60 bits of the MD5 of its key. A bucket is a prefix of hash bits; starting from the empty
prefix, a bucket whose rows exceed the byte limit is split on its next bit, and only such a bucket. A bucket that fits
is a shard. The directory is worked out from sums of bytes by prefix: one aggregation gives the sums some bits deeper than
an even spread would need; the sums of all shorter prefixes follow from these few rows. Buckets that still
exceed the limit there are refined by more bits, and only their rows are read for that.

A bucket of one key can't be split by its hash. If it exceeds the limit, its rows are dealt into pages of at most the limit
within each partition of a written table, so that no task gathers them all and a task that runs again numbers them alike; a row larger than the limit has a page of its own.

Defined cases: null text has no bytes; a null key is hashed as the empty string; repeated rows share a bucket; extra
columns are written to the files, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sondage.llm.common import BROADCAST_IDS, Staging

HASH_BITS = 60
#: Bits beyond an even spread in the first aggregation, and in each refinement.
MORE_BITS = 6
#: Columns that name the folders of the files, and those that give the shard and page of a row read back.
FOLDERS, READ = ("in_shard", "in_page"), ("shard", "page")


def _free(df: DataFrame, names: tuple[str, ...]) -> tuple[str, ...]:
    """The names, each with as many underscores after it as it takes to differ from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name in taken:
            name += "_"
        found.append(name)
    return tuple(found)


def hash_bits(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def _directory(rows: DataFrame, low: int, high: int, limit: int, stage: Staging) -> tuple[DataFrame, DataFrame]:
    """(shards, over): of depths low to high, the buckets that fit, by each prefix of ``high`` bits; and the prefixes of ``high`` bits that exceed."""
    fine = rows.groupBy(F.shiftright("hash", HASH_BITS - high).alias("prefix")).agg(F.sum("n_bytes").alias("n_bytes"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
    fine = stage.put(fine, "prefixes")
    depths = fine.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
    bucket = F.expr(f"shiftright(prefix, {high} - depth)")
    sums = depths.groupBy("depth", bucket.alias("bucket")).agg(F.sum("n_bytes").alias("bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    sums = sums.select("depth", "bucket", "bytes", ((F.col("bytes") <= limit) | (F.col("lo") == F.col("hi"))).alias("fits"))
    sums = stage.put(sums, "buckets")
    split = sums.where(~F.col("fits")).select((F.col("depth") + 1).alias("depth"), F.col("bucket").alias("parent"))
    shards = sums.where("fits").withColumn("parent", F.shiftright("bucket", 1)).join(split, ["depth", "parent"], "left_semi")
    if low == 0:
        shards = shards.unionByName(sums.where("fits and depth = 0").withColumn("parent", F.lit(0).cast("long")))
    width = F.expr(f"shiftleft(1L, {high} - depth)")
    shards = shards.withColumn("prefix", F.explode(F.sequence(F.col("bucket") * width, (F.col("bucket") + 1) * width - 1)))
    return stage.put(shards.select("prefix", "depth", "bucket", "bytes"), "shards"), sums.where((F.col("depth") == high) & ~F.col("fits")).select(F.col("bucket").alias("prefix"))


def _measured(df: DataFrame, key: str, content: str) -> DataFrame:
    """(row, hash, n_bytes): ``row`` holds all columns."""
    return df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("row"), hash_bits(df[key]).alias("hash"), F.coalesce(F.octet_length(df[content]), F.lit(0)).cast("long").alias("n_bytes"))


def _directories(rows: DataFrame, limit: int, stage: Staging) -> list[tuple[int, DataFrame]]:
    """(bits, shards by prefix of so many bits) of all rows (hash, n_bytes); each row is in one of them."""
    left = stage.put(rows, "rows")
    total = left.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + MORE_BITS)
    done = []
    while True:
        found, over = _directory(left, low, high, limit, stage)
        done.append((high, found))
        if high == HASH_BITS or over.isEmpty():
            return done
        at = left.withColumn("prefix", F.shiftright("hash", HASH_BITS - high))
        left = stage.put(at.join(over, "prefix", "left_semi").drop("prefix"), "rows")
        low, high = high + 1, min(HASH_BITS, high + MORE_BITS)


def _placed(df: DataFrame, key: str, content: str, limit: int) -> DataFrame:
    """(row, n_bytes, depth, shard, page) of each row, whatever its key."""
    rows, stage, crowded = _measured(df, key, content), Staging(df.sparkSession, "shards"), False
    for high, found in _directories(rows.select("hash", "n_bytes"), limit, stage):
        crowded = crowded or not found.where(F.col("bytes") > limit).isEmpty()
        found = found.select(F.col("prefix").alias("at"), F.struct("depth", "bucket", "bytes").alias("now"))
        few = found.count() <= BROADCAST_IDS
        rows = rows.withColumn("at", F.shiftright("hash", HASH_BITS - high)).join(F.broadcast(found) if few else found, "at", "left").drop("at")
        rows = rows.withColumn("found", F.coalesce("found", "now") if "found" in rows.columns else F.col("now")).drop("now")
    out = rows.select("row", "n_bytes", F.col("found.depth").alias("depth"), F.col("found.bucket").alias("bucket"), (F.col("found.bytes") > limit).alias("over"))
    out = out.withColumn("shard", F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(bucket), depth, '0')")))
    fits = out.where("not over").withColumn("page", F.lit("0"))
    if crowded:
        fits = fits.unionByName(_pages(stage.put(out.where("over"), "over"), limit))
    return fits.select("row", "n_bytes", F.col("depth").cast("int").alias("depth"), "shard", "page")


def shards(df: DataFrame, key: str, content: str, limit: int) -> DataFrame:
    """(key, n_bytes, depth, shard, page) of each row: ``shard`` is the bucket's bits as text."""
    return _placed(df.select(key, content), key, content, limit).select(F.col("row")[key].alias(key), "n_bytes", "depth", "shard", "page")


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of buckets of one key over the limit, a written table, dealt into pages within each of its partitions.

    A page of small rows takes those that start in the same half of the limit; each row over half the limit is a page.
    """
    rows = rows.withColumn("part", F.spark_partition_id()).withColumn("large", 2 * F.col("n_bytes") > limit).withColumn("n", F.monotonically_increasing_id())
    order = Window.partitionBy("shard", "part", "large").orderBy("n")
    start = F.sum("n_bytes").over(order) - F.col("n_bytes")
    number = F.when(F.col("large"), F.row_number().over(order)).otherwise(F.floor(2 * start / limit))
    return rows.withColumn("page", F.concat_ws("-", F.when(F.col("large"), "l").otherwise("s"), "part", number)).drop("part", "large", "n")


def write_shards(df: DataFrame, key: str, content: str, limit: int, path: str) -> None:
    """Writes all rows and columns of ``df`` with one folder for each shard and page. The folders' columns are ``FOLDERS``, with underscores after them where ``df`` has such columns."""
    folders = _free(df, FOLDERS)
    # Letters before the names, as an empty name or digits alone would be read back as null or a number.
    rows = _placed(df, key, content, limit).select("row.*", F.concat(F.lit("s"), "shard").alias(folders[0]), F.concat(F.lit("p"), "page").alias(folders[1]))
    rows.repartition(*folders).write.partitionBy(*folders).parquet(path)


def read_shards(df: DataFrame, path: str) -> DataFrame:
    """The rows that ``write_shards`` has written of ``df``, with ``shard`` and ``page`` of their folders; ``df``'s own columns of such names stay, and those of the folders get underscores."""
    folders, read = _free(df, FOLDERS), _free(df, READ)
    rows = df.sparkSession.read.schema(StructType([*df.schema.fields, *(StructField(x, StringType()) for x in folders)])).parquet(path)
    return rows.select(*(F.col(f"`{c}`") for c in df.columns), *(F.expr(f"substring({x}, 2)").alias(name) for x, name in zip(folders, read, strict=True)))


def written_shards(df: DataFrame, key: str, content: str, limit: int, path: str) -> DataFrame:
    """(key, n_bytes, depth, shard, page) as read back from the files, whose rows and byte sums are checked."""
    write_shards(df, key, content, limit, path)
    shard, page = _free(df, READ)
    rows = read_shards(df, path).select(F.col(key), F.coalesce(F.octet_length(content), F.lit(0)).cast("long").alias("n_bytes"), F.length(shard).alias("depth"), F.col(shard).alias("shard"), F.col(page).alias("page"))
    held = rows.groupBy("shard", "page").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"))
    n, over = held.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if((F.col("n") > 1) & (F.col("bytes") > limit))).first()
    if over or n != df.count():
        raise ValueError(f"{n} rows written, {over} pages of several rows over the limit")
    return rows
