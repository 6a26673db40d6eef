"""Records of delimited text over splits against Python's csv module, and what a scan keeps and rejects."""

from __future__ import annotations

import csv
import io
import random

import pytest

from sondage.sources import delimited, records


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding) if isinstance(text, str) else text)
    return str(path)


def plain(text, delimiter):
    """(line, fields) of the records that aren't blank."""
    lines = text.split("\n")
    reader = csv.reader(iter([x + "\n" for x in lines]), delimiter=delimiter)
    out, before = [], 0
    for row in reader:
        if row:
            out.append((before + 1, row))
        before = reader.line_num
    return out


def text_of(seed, rows):
    rng = random.Random(seed)
    parts = ["a", "b c", "", "é", "x" * 30, '"q"', '"a;b"', '"two\nlines"', '"say ""hi"""', '"\n\n"', '"""start"', '5"', 'mid"dle;', '""']
    return "h1;h2;h3\n" + "".join(";".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) + rng.choice(["\n", "\n", "\n\n"]) for _ in range(rows))


@pytest.mark.parametrize("bytes_a_split", [150, 1 << 20])
def test_against_csv_module(spark, tmp_path, bytes_a_split):
    """Splits of any size, also such that records and quoted fields cross several of them."""
    text = text_of(bytes_a_split, 60)
    path = write(tmp_path / "a.csv", text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_a_split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        found = sorted((r.line, list(r.fields)) for r in records.records(spark, path, ";").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert found == plain(text, ";")


@pytest.mark.parametrize("line", ["", "a", '"', '"a', '"a"', '"a";', 'a"b;"c', '"a""', '"a"";"', ';"', '"a"x"y;"z', '""', '"""'])
def test_quotes_by_line(line):
    """A quoted field is open after a line exactly if the csv module asks for more."""

    def inside(text):
        return len(next(csv.reader(io.StringIO(text + "\n#\n"), delimiter=";"))) and "#" in "".join(next(csv.reader(io.StringIO(text + "\n#\n"), delimiter=";")))

    assert records.ends_inside(line, False, ";") == inside(line)
    assert records.ends_inside(line, True, ";") == inside('"x\n' + line)


def test_scan_keeps_pads_and_rejects(spark, tmp_path):
    text = '﻿id;name;id;\r\n1;"a\nb";2;3\r\n\r\n2;c\r\n3;d;2;9;9\r\n"4\n";x;y;z;w;v\r\n5;"e;f";;7\r\n'
    found = delimited.scan(spark, write(tmp_path / "a.csv", text))
    assert found.rows.columns == ["id", "name", "id_1", "column_4"]
    assert sorted((r[0], r[1], r[2], r[3]) for r in found.rows.collect()) == [(1, "a\nb", 2, 3), (2, "c", None, None), (5, "e;f", None, 7)]
    assert sorted((r.line, r.raw, r.n_fields, r.n_expected) for r in found.rejected.collect()) == [(6, "3;d;2;9;9", 5, 4), (7, '"4\n";x;y;z;w;v', 6, 4)]
    assert tuple(delimited.scan_report(found).first()) == (3, 2)


def test_files_that_are_rejected(spark, tmp_path):
    for name, text, why in [("a.csv", "", "empty"), ("b.csv", " \n\n", "empty"), ("c.csv", "a;b\n", "no valid row"), ("d.csv", "a;b\n1;2;3\n", "no valid row"), ("e.txt", "a;b\n1;2\n", "only .csv")]:
        with pytest.raises(delimited.Rejected, match=why):
            delimited.scan(spark, write(tmp_path / name, text))
    with pytest.raises(delimited.Rejected, match="larger"):
        delimited.scan(spark, write(tmp_path / "f.csv", "a;b\n1;2\n"), most_bytes=3)
    with pytest.raises(delimited.Rejected, match="exist"):
        delimited.scan(spark, str(tmp_path / "none.csv"))


def test_bytes_that_are_no_text(spark, tmp_path):
    found = delimited.scan(spark, write(tmp_path / "a.csv", b"a,b\n1,\xff\xe9\n2,x\n"))
    assert sorted((r.a, r.b) for r in found.rows.collect()) == [(1, "��"), (2, "x")]


def test_an_open_quote_takes_the_rest(spark, tmp_path):
    found = records.records(spark, write(tmp_path / "a.csv", 'a;b\n1;"x\n2;y\n'), ";")
    assert sorted((r.line, r.raw) for r in found.collect()) == [(1, "a;b"), (2, '1;"x\n2;y')]
