"""Suffix statistics and training rows of the URL filter when there are more labelled rows than the sample takes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage.llm import url_filter


def labelled(spark, rows):
    frame = spark.createDataFrame(rows, "page_id long, url string, blocked boolean")
    host, path = url_filter.host_and_path(F.col("url"))
    return frame.select("*", host.alias("host"), path.alias("path"))


def test_suffixes_count_all_labelled_rows(spark):
    rows = [(i, f"http://www.s{i % 300}.org/{i}", i % 300 < 100) for i in range(1500)]
    model = url_filter.UrlModel(labelled(spark, rows), sample=60)
    got = {r.suffix: (r.suffix_count, r.suffix_rate) for r in model.suffixes.collect()}
    assert got == {f"s{k}.org": (5.0, (5 * (k < 100) + 1) / 7) for k in range(300)}


def test_rare_verdict_is_trained_on(spark):
    """Two blocked rows among 2,000: a uniform sample of 20 mostly has none of them."""
    rows = [(i, f"http://a{i}.com/news", False) for i in range(2000)] + [(5000 + i, f"http://b.info/{i}?q=1&r=2", True) for i in range(2)]
    frame = labelled(spark, rows)
    assert url_filter.UrlModel(frame, sample=20).model is not None
    kinds = url_filter._sample(frame, 2000, 2, 20).groupBy("blocked").count().collect()
    kinds = {r.blocked: r["count"] for r in kinds}
    assert kinds[True] == 2 and 5 <= kinds[False] <= 40


def test_copies_of_one_url_are_sampled_by_row(spark):
    rows = [(i, "http://hot.com/x", False) for i in range(2000)] + [(5000 + i, f"http://b.info/{i}", True) for i in range(2000)]
    n = url_filter._sample(labelled(spark, rows), 2000, 2000, 400).where("url = 'http://hot.com/x'").count()
    assert 120 <= n <= 280
