"""One reader of the records of delimited text: quoted fields with line feeds, true line numbers, the raw text of each record.

Lines are read in splits, and a split may begin inside a quoted field. The first pass tells of each split how many lines it has, and for both cases, that it begins outside or inside of quotes, how it ends and where its last record
starts. From these few rows follows how each split begins. The second pass reads the same splits and puts the records together; only lines of a record that goes on over the border of a split are joined afterwards.

A quote opens a quoted field only where a field begins; inside, two quotes are one. What stands between a closing quote and the next delimiter belongs to the field. Lines end with a line feed, a carriage return before it
is dropped at the end of a record.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.sources.staging import Staging

_CLOSE = re.compile(r'[^"]*+(?:""[^"]*+)*+"')
_MARK = "﻿"


def ends_inside(line: str, inside: bool, delimiter: str) -> bool:
    """Whether a quoted field is open after a line that begins inside or outside of one."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside or line.startswith('"', at):
            found = _CLOSE.match(line, at if inside else at + 1)
            if not found:
                return True
            at, inside = found.end(), False
        at = line.find(delimiter, at)
        if at < 0:
            return False
        at += len(delimiter)


def fields(raw: str, delimiter: str) -> list[str]:
    """The fields of a record; none of a blank one."""
    if '"' not in raw:
        return raw.split(delimiter) if raw.strip() else []
    try:
        return next(csv.reader([raw], delimiter=delimiter), [])
    except csv.Error:  # a bare carriage return or a field over the module's limit
        out, at = [], 0
        while at >= 0:
            end = _CLOSE.match(raw, at + 1).end() if raw.startswith('"', at) and _CLOSE.match(raw, at + 1) else at
            stop = raw.find(delimiter, end)
            part = raw[at : stop if stop >= 0 else len(raw)]
            out.append(part[1 : end - at - 1].replace('""', '"') + part[end - at :] if end > at else part)
            at = stop + len(delimiter) if stop >= 0 else -1
        return out


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, value) of all lines, those of a split in order."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))


def _splits(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """(file and split, its lines), of batches in which the lines of a split are together. The lines of one have to be taken before the next."""
    rows = ((key, value.decode(errors="replace")) for pdf in batches for *key, value in zip(pdf["file"], pdf["split"], pdf["value"], strict=True))
    now = next(rows, None)

    def lines(key: list) -> Iterator[str]:
        nonlocal now
        while now is not None and now[0] == key:
            yield now[1]
            now = next(rows, None)

    while now is not None:
        key = now[0]
        yield tuple(key), lines(key)


def _begin(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """(file, split, first, inside, start): the number of a split's first line, whether it begins inside of quotes, and the line of the record that it goes on with then."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (file, split), lines in _splits(batches):
            states, starts, count = [False, True], [-1, -1], 0
            for line in lines:
                for i in (0, 1):
                    if not states[i]:
                        starts[i] = count
                    states[i] = ends_inside(line, states[i], delimiter)
                count += 1
            yield pd.DataFrame({"file": [file], "split": [split], "count": [count], "out_end": [states[0]], "in_end": [states[1]], "out_start": [starts[0]], "in_start": [starts[1]]})

    found = _lines(spark, path).mapInPandas(look, "file string, split long, count long, out_end boolean, in_end boolean, out_start long, in_start long")
    # A row for each file with its splits in order; a split is many megabytes.
    files = found.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("split", "count", "out_end", "in_end", "out_start", "in_start"))).alias("splits"))
    none = F.expr("cast(array() as array<struct<split: bigint, first: bigint, inside: boolean, start: bigint>>)")
    begun = F.struct(none.alias("done"), F.lit(0).cast("long").alias("first"), F.lit(False).alias("inside"), F.lit(0).cast("long").alias("start"))

    def step(s: F.Column, x: F.Column) -> F.Column:
        now = F.struct(x["split"].alias("split"), s["first"].alias("first"), s["inside"].alias("inside"), s["start"].alias("start"))
        last = F.when(s["inside"], x["in_start"]).otherwise(x["out_start"])
        return F.struct(
            F.concat(s["done"], F.array(now)).alias("done"),
            (s["first"] + x["count"]).alias("first"),
            F.when(s["inside"], x["in_end"]).otherwise(x["out_end"]).alias("inside"),
            F.when(last >= 0, s["first"] + last).otherwise(s["start"]).alias("start"),
        )

    return files.select("file", F.inline(F.aggregate("splits", begun, step)["done"]))


def records(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """(file, line, raw, fields) of the records that aren't blank, as a written table: ``line`` is the number of the record's first line, from 1 on."""
    if len(delimiter) != 1 or delimiter in '"\n\r':
        raise ValueError("the delimiter is one character other than a quote or line end")
    stage = Staging(spark, "records")
    begin = stage.put(_begin(spark, path, delimiter), "splits")
    # One row a split, of many megabytes each.
    rows = _lines(spark, path).join(F.broadcast(begin), ["file", "split"], "left").select("file", "split", "value", "first", "inside", "start")

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, int], tuple[int, bool, int]] = {}

        def noted() -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for key in pdf.drop_duplicates(["file", "split"]).itertuples(index=False):
                    known[key.file, key.split] = (int(key.first), bool(key.inside), int(key.start))
                yield pdf

        out: list[tuple] = []
        for (file, split), lines in _splits(noted()):
            number, inside, start = known[file, split]
            held, whole = [], not inside
            for line in lines:
                if not inside:
                    if held:
                        out.append((file, start, split, whole, "\n".join(held)))
                    held, whole, start = [], True, number
                    if number == 0:
                        line = line.removeprefix(_MARK)
                held.append(line)
                inside = ends_inside(line, inside, delimiter)
                number += 1
                if len(out) >= 4096:
                    yield frame(out)
                    out = []
            # A record that goes on in the next split is a part like what the next one begins with.
            out.append((file, start, split, whole and not inside, "\n".join(held)))
        if out:
            yield frame(out)

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["file", "line", "split", "whole", "raw"])

    parts = stage.put(rows.mapInPandas(gather, "file string, line long, split long, whole boolean, raw string"), "parts")
    broken = parts.where("not whole").groupBy("file", "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split", "raw"))), lambda x: x["raw"]), "\n").alias("raw"))
    found = parts.where("whole").select("file", "line", "raw").union(broken)

    @F.pandas_udf("array<string>")
    def parsed(raw: pd.Series) -> pd.Series:
        return pd.Series([fields(x, delimiter) for x in raw])

    raw = F.regexp_replace("raw", r"\r$", "")
    found = found.select("file", (F.col("line") + 1).alias("line"), raw.alias("raw")).withColumn("fields", parsed("raw"))
    return stage.put(found.where(F.size("fields") > 0), "records")
