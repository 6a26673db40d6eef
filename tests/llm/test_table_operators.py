"""Tool calls, sharding, URL filter and the pipeline."""

from __future__ import annotations

import json
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from sondage.llm import queries, sharding, tool_calls, url_filter
from sondage.llm.common import table

SCHEMAS = {"add": {"properties": {"x": "number", "tags": "array", "n": "integer"}, "required": ["x"]}}


def test_canonical_json():
    assert tool_calls.canonical({"b": 1.0, "a": [True, None, "é\n\""], "\U0001f600": 1, "\ufb33": 2}) == '{"a":[true,null,"é\\n\\""],"b":1,"\U0001f600":1,"\ufb33":2}'
    assert tool_calls.check_arguments("add", '{"x": 1e2, "n": 2.5, "y": 0}', SCHEMAS) == ('{"n":2.5,"x":100,"y":0}', ["n is not integer", "unknown y"])
    assert tool_calls.check_arguments("add", "{", SCHEMAS) == (None, ["malformed"])
    assert tool_calls.check_arguments("add", None, SCHEMAS) == (None, ["malformed"])
    assert tool_calls.check_arguments("sub", "{}", SCHEMAS) == ("{}", ["unknown tool"])
    assert tool_calls.check_arguments("add", "{}", SCHEMAS) == ("{}", ["missing x"])


def test_linking_and_order(spark):
    rng = random.Random(1)
    calls, results = [], []
    for conv in range(8):
        n = 700 if conv == 0 else rng.randrange(1, 12)
        for turn in range(n):
            needs = [f"c{rng.randrange(turn)}"] if turn and rng.random() < 0.7 else ["gone"]
            calls.append((conv, f"c{turn}", turn, "add", json.dumps({"x": turn}), needs))
            if rng.random() < 0.8:
                results += [(conv, f"c{turn}", turn + 1, "r"), (conv, f"c{turn}", turn + 2, "later")]
    # Turns against the order of dependencies, a cycle, and what hangs on it.
    calls += [(50, "a", 1, "add", "{}", ["c"]), (50, "b", 2, "add", "{}", ["a"]), (50, "c", 3, "add", "{}", ["d"]), (50, "d", 4, "add", "{}", None), (50, "e", 9, "add", "{}", ["a"])]
    calls += [(51, "a", 1, "add", "{}", ["b"]), (51, "b", 2, "add", "{}", ["a"]), (51, "c", 3, "add", "{}", ["b"]), (51, "d", 4, "add", "{}", [])]
    calls += [(None, "x", 1, "add", "{}", None), (60, None, 1, "add", "{}", None), (61, "a", None, None, None, None)]
    schema = "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>"
    out = tool_calls.linked(spark.createDataFrame(calls + calls[:5], schema), spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string"), SCHEMAS).collect()
    assert len(out) == len(calls) - 2
    by = {(r.conv_id, r.call_id): r for r in out}
    sizes = Counter(r.conv_id for r in out)
    for conv, size in sizes.items():
        assert sorted(r.topo_rank for r in out if r.conv_id == conv) == list(range(1, size + 1))
    for conv, call, turn, _, _, needs in calls:
        if conv is None or call is None:
            continue
        r = by[conv, call]
        if conv < 50:
            assert r.topo_rank == turn + 1
        for x in needs or []:
            if (conv, x) in by and not r.cyclic:
                assert by[conv, x].topo_rank < r.topo_rank
    assert [c for c, _ in sorted(((r.call_id, r.topo_rank) for r in out if r.conv_id == 50), key=lambda x: x[1])] == ["d", "c", "a", "b", "e"]
    assert {r.call_id for r in out if r.cyclic} == {"a", "b", "c"}
    first = {(c, i): t for c, i, t, _ in reversed(results)}
    assert all(r.result_turn == first.get((r.conv_id, r.call_id)) for r in out)
    assert by[61, "a"].errors == ["malformed"] and by[61, "a"].canonical is None


def test_parse_turns_and_empty(spark):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", '{"tool_calls": [{"id": "a", "name": "add", "arguments": {"x": 2, "n": 1}, "depends_on": ["z"]}, {"id": "b", "name": "add", "arguments": "{\\"x\\": 3}"}]}'),
        (1, 2, "tool", '{"tool_call_id": "a", "content": "five"}'),
        (1, 3, "assistant", None),
        (1, 4, "tool", "not json"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.call_id: r for r in tool_calls.linked(*tool_calls.parse_turns(turns), SCHEMAS).collect()}
    assert got["a"].content == "five" and got["a"].canonical == '{"n":1,"x":2}' and got["a"].errors == []
    assert got["b"].content is None and got["b"].canonical == '{"x":3}'
    none = turns.limit(0)
    assert tool_calls.linked(*tool_calls.turns_as_calls(none, "add"), SCHEMAS).collect() == []


def brute_shards(rows, limit):
    """rows: (row, hash, bytes)."""
    out = {}

    def split(part, depth):
        if sum(b for _, _, b in part) <= limit or len({h for _, h, _ in part}) <= 1:
            for r, h, _ in part:
                out[r] = format(h >> (60 - depth), f"0{depth}b") if depth else ""
            return
        bit = 59 - depth
        for v in (0, 1):
            side = [x for x in part if x[1] >> bit & 1 == v]
            if side:
                split(side, depth + 1)

    split(rows, 0)
    return out


@pytest.mark.parametrize("limit", [100, 3000, 10**9])
def test_shards(spark, limit):
    rng = random.Random(3)
    rows = [(i, "x" * rng.choice([0, 3, 50, 90])) for i in range(600)] + [(700, None), (701, "é" * 80), (None, "abc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", sharding.hash_bits(F.col("doc_id")).alias("h")).collect()}
    want = brute_shards([(i, hashes[i], len((t or "").encode())) for i, t in rows], limit)
    got = sharding.shards(docs, "doc_id", "text", limit).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.shard for r in got} == want
    held = Counter()
    for r in got:
        assert r.n_bytes == len((dict(rows)[r.doc_id] or "").encode()) and r.depth == len(r.shard)
        held[r.shard, r.page] += r.n_bytes
    assert all(v <= limit or limit < 160 for v in held.values())


def test_shards_of_one_hot_key(spark):
    rows = [(1, "x" * 40)] * 50 + [(1, "y" * 150)] * 3 + [(i, "z" * 10) for i in range(2, 40)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text", 100).collect()
    assert len(got) == len(rows)
    held, count = Counter(), Counter()
    for r in got:
        held[r.shard, r.page] += r.n_bytes
        count[r.shard, r.page] += 1
    assert all(v <= 100 or count[k] == 1 for k, v in held.items())
    assert sharding.shards(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", 100).collect() == []


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in queries.RULES:
        at, slash, tail = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith(slash + tail) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best


def test_url_rules_and_model(spark, sf_dir):
    urls = [None, "", "nothing", "http://", "://x.org", "HTTP://A.Example.ORG/es/1?x#y", "http://org/", "http://a.borg/", "http://x.com?a=/fr/", "http://u@x.com/de/#f", "http://a://b.org/x", "http://x.org\n/y", "http://É.com/fr/", "http://example.org/en/19", "http://example.org/en/2"]
    extra = spark.createDataFrame([(10_000 + i, u) for i, u in enumerate(urls)], "page_id long, url string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url").union(extra).withColumn("host", F.lit("clash"))
    got = url_filter.judged(pages, [url_filter.Rule.parse(*x) for x in queries.RULES]).collect()
    by = {r.page_id: r.url for r in pages.collect()}
    assert len(got) == len(by)
    for r in got:
        host, path, best = brute_rule(by[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")


def test_url_model_accuracy(spark):
    """Held-out accuracy on URLs whose kind shows in their form."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        bad = rng.random() < 0.4
        name = "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
        path = "/".join(str(rng.randrange(10**6)) for _ in range(4)) + f"?id={rng.randrange(10**9)}&s={rng.randrange(10**9)}" if bad else rng.choice(["about", "news/today"])
        rows.append((i, f"http://{name}.{'info' if bad and rng.random() < 0.5 else 'example.com'}/{path}", bad))
    frame = spark.createDataFrame(rows, "page_id long, url string, blocked boolean")
    host, path = url_filter.host_and_path(F.col("url"))
    frame = frame.select("*", host.alias("host"), path.alias("path"))
    model = url_filter.UrlModel(frame.where("page_id < 400"))
    held = model.blocked(frame.where("page_id >= 400").drop("blocked")).collect()
    assert sum(r.blocked == rows[r.page_id][2] for r in held) / len(held) >= 0.95
    none = url_filter.UrlModel(frame.where("blocked"))
    assert not any(r.blocked for r in none.blocked(frame.drop("blocked")).collect())
    assert url_filter.judged(frame.limit(0), [url_filter.Rule.parse("allow", "org/")]).collect() == []


def test_entropy(spark):
    got = url_filter.with_features(spark.createDataFrame([("aabb", "", ""), ("abcd", "", ""), ("", "", ""), (None, "", "")], "url string, host string, path string")).collect()
    assert [round(r.entropy, 6) for r in got] == [1.0, 2.0, 0.0, 0.0]


def test_all_queries_run(spark, sf_dir):
    assert [n for n in queries.QUERIES] == sorted(queries.QUERIES, key=lambda n: int(re.match(r"op(\d+)_", n)[1]))
    assert len(queries.QUERIES) == 10


def test_pipeline_is_its_stages(spark, sf_dir):
    """The pipeline's rows are those of the brute-force versions of its stages."""
    import hashlib

    import corpus_pipeline
    from sondage.llm import line_dedup
    from tests.llm.test_text_operators import brute_measures
    from tests.llm.test_words_and_links import brute_components, brute_contaminated

    docs = table(spark, sf_dir, "documents")
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    rows = {i: t for i, t in rows.items() if (m := brute_measures(t))[0] >= 20 and 100 * m[4] <= 30 * m[0]}
    lines = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs.where(F.col("doc_id").isin(list(rows)))).collect()}
    rows = {i: t for i, t in lines.items() if t.split()}
    parts = brute_components(list(rows.items()))
    rows = {i: t for i, t in rows.items() if parts[i] == i}
    bad = {d for d, *_ in brute_contaminated(list(rows.items()), items)}
    rows = {i: t for i, t in rows.items() if i not in bad}
    assert {i: r.decoded_sha256 for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows.items()}
    assert 0 < len(got) < docs.count()


def test_canonical_numbers_and_odd_schemas():
    for x, want in ((1e-7, "1e-7"), (1.5e-9, "1.5e-9"), (1e21, "1e+21"), (123e20, "1.23e+22"), (1e20, "100000000000000000000"), (0.000001, "0.000001"), (-12.5, "-12.5"), (0.1, "0.1"), (100.0, "100"), (-0.0, "0"), (5e-324, "5e-324"), (1234.5678, "1234.5678")):
        assert tool_calls.canonical(x) == want and float(want) == x
    assert tool_calls.check_arguments("f", '{"x": "\\ud800"}', {"f": {}}) == (None, ["malformed"])
    assert tool_calls.check_arguments("f", '{"x": NaN}', {"f": {}}) == (None, ["malformed"])
    assert tool_calls.check_arguments("f", '{"x": 1}', {"f": {}}) == ('{"x":1}', ["unknown x"])
    assert tool_calls.check_arguments("f", '{"x": 1}', {"f": {"properties": {"x": "date"}}})[1] == ["x has the unknown type date"]


def test_a_long_circle_takes_few_jobs(spark):
    """300 calls of which two need each other: rounds hang on the chain of late dependencies, not on the count of calls."""
    calls = spark.createDataFrame([(1, f"t{i}", i, "f", "{}", ["t1"] if i == 0 else ["t0"] if i == 1 else ["t1"] if i == 2 else []) for i in range(300)], "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    spark.sparkContext.setJobGroup("circle", "")
    rows = {r.turn: r for r in tool_calls.linked(calls, results, {"f": {}}).collect()}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("circle")) < 120
    spark.sparkContext.setJobGroup("", "")
    assert [i for i, r in rows.items() if r.cyclic] == [0, 1, 2] and rows[3].topo_rank == 1 and rows[2].topo_rank == 300


def test_sql_of_the_queries(spark, sf_dir):
    """Each query of the subpackage with SQL against DuckDB."""
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    for name, sql in queries.ORACLES.items():
        found = queries.QUERIES[name](spark, sf_dir)
        columns = sorted(found.columns)
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert sorted(str([plain(r[c]) for c in columns]) for r in found.collect()) == sorted(str([plain(r[i]) for i in at]) for r in cursor.fetchall()), name
