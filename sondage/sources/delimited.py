"""Delimited text: gate, delimiter detection, scan with over-long rows set apart, log of rejected lines."""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.sources.records import records

# Candidates in order of preference.
DELIMITERS = [";", ",", "\t", "|"]
MOST_BYTES = 50 * 1024 * 1024


class Rejected(ValueError):
    """A file that can't be taken."""


@dataclass
class Scan:
    """A scanned file: its rows, and (line, raw, n_fields, n_expected) of the rejected lines."""

    rows: DataFrame
    rejected: DataFrame
    delimiter: str


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """The candidate that is most frequent in the second non-blank line (the first if there is only one)."""
    lines = [r.value for r in spark.read.text(path).where("trim(value) <> ''").limit(2).collect()]
    if not lines:
        raise Rejected("the file is empty")
    counts = [lines[-1].count(d) for d in DELIMITERS]
    if max(counts):
        return DELIMITERS[counts.index(max(counts))]
    try:
        return csv.Sniffer().sniff("\n".join(lines)[:4096]).delimiter
    except csv.Error:
        return ","


def gate(spark: SparkSession, path: str, most_bytes: int | None = MOST_BYTES) -> None:
    """Only ``.csv`` files up to a size; without a size limit for tables of any size."""
    if not path.lower().endswith(".csv"):
        raise Rejected("only .csv files are taken")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(target):
        raise Rejected("the file doesn't exist")
    if most_bytes is not None and system.getContentSummary(target).getLength() > most_bytes:
        raise Rejected(f"the file is larger than {most_bytes} bytes")


def scan(spark: SparkSession, path: str, delimiter: str | None = None, infer: bool = True, most_bytes: int | None = None) -> Scan:
    """Rows with a header; short rows are padded with nulls, records with too many fields are set apart with the number of their first line and their raw text.

    Rows, rejects and line numbers come from one reader, so each record is in exactly one of the two; quoted fields may hold line feeds. Bytes that aren't UTF-8 are replaced. Types are inferred from
    the rows that are kept. A file without text, and one without a row that can be kept, are rejected. ``most_bytes`` is the limit of ``gate``.
    """
    gate(spark, path, most_bytes)
    delimiter = delimiter or detect_delimiter(spark, path)
    found = records(spark, path, delimiter)
    heads = found.groupBy("file").agg(F.min("line").alias("line"), F.min_by("fields", "line").alias("names"))
    first = heads.orderBy("file").first()
    if first is None:
        raise Rejected("the file is empty")
    names = unique([n.strip() or f"column_{i}" for i, n in enumerate(first.names, 1)])
    # Each file has a header, which is its first record; one row a file.
    rows = found.join(F.broadcast(heads.select("file", "line")), ["file", "line"], "left_anti")
    over = F.size("fields") > len(names)
    cells = [F.nullif(F.get("fields", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]
    kept = rows.where(~over).select(*cells)
    if kept.isEmpty():
        raise Rejected(f"no valid row with the delimiter {delimiter!r}")
    rejected = rows.where(over).select("line", "raw", F.size("fields").alias("n_fields"), F.lit(len(names)).alias("n_expected"))
    return Scan(inferred(kept) if infer else kept, rejected, delimiter)


def unique(names: list[str]) -> list[str]:
    """Repeated names with a number: a, a_1, a_2. Letter case doesn't tell names apart."""
    seen: set[str] = set()
    out = []
    for name in names:
        own, k = name, 0
        while own.lower() in seen:
            k += 1
            own = f"{name}_{k}"
        seen.add(own.lower())
        out.append(own)
    return out


def inferred(df: DataFrame) -> DataFrame:
    """Text columns as long, double or boolean where all non-null values are such. One aggregation."""
    tests = {"bigint": r"^\s*[+-]?\d{1,18}\s*$", "double": r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|Infinity|NaN|nan)\s*$", "boolean": r"^(True|False|true|false|TRUE|FALSE)$"}
    empty = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    missing = ["NA", "N/A", "n/a", "NaN", "nan", "null", "NULL", "None", "<NA>", "#N/A"]
    cell = lambda c: F.when(~empty(c).isin(missing), F.col(c))
    one = df.agg(*(x for i, c in enumerate(df.columns) for x in (F.count(cell(c)).alias(f"n{i}"), *(F.count_if(cell(c).rlike(p)).alias(f"{k}{i}") for k, p in tests.items())))).first()

    def kind(i: int) -> str:
        n = one[f"n{i}"]
        if not n:
            return "string"
        return next((k for k in ("bigint", "boolean") if one[f"{k}{i}"] == n), "double" if one[f"double{i}"] + 0 == n or one[f"double{i}"] + one[f"bigint{i}"] >= n and one[f"double{i}"] == n else "string")

    return df.select(*((F.trim(cell(c)).try_cast(kind(i)) if kind(i) != "string" else cell(c)).alias(c) for i, c in enumerate(df.columns)))


def scan_report(found: Scan) -> DataFrame:
    """One row: kept and rejected lines."""
    return found.rows.agg(F.count("*").alias("n_rows")).join(found.rejected.agg(F.count("*").alias("n_rejected")))
