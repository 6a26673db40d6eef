"""Tool calls of conversations: linked to their results, put in topological order, validated, as canonical JSON.

Calls (conv_id, call_id, turn, name, arguments, depends_on) and results (conv_id, call_id, turn, content) are joined by
identifier; identifiers are unique within a conversation, so that a large conversation is spread over many tasks. Of results that
share an identifier the first turn counts, of calls as well (ties: the smallest content).

Order: a call comes after the calls whose identifiers it depends on. Its place is its own turn, or that of its latest
dependency if that is later, and then one step behind it; ties keep turns in order. Only calls with a dependency that isn't
earlier, and what depends on them, are placed step by step. A call on a cycle, or behind one, has no
place: it comes last and is marked. Ranks are counted by stretches of ``STRETCH`` turns and then inside a stretch, so that no
conversation is ranked in one task.

Arguments are parsed as JSON and validated against the tool's schema: ``{"properties": {name: type}, "required": [name]}`` with the
JSON types string, integer, number, boolean, array, object, null; unknown properties are errors, and so is a type that
isn't one of these; a schema without properties knows none. Canonical JSON has sorted keys
(by UTF-16 code units), no spaces, integral numbers without a fraction, and minimal escapes.

Defined cases: null or malformed arguments (a lone surrogate, NaN and infinity among them) are the error ``malformed`` and have no canonical form; an unknown tool is the error
``unknown tool``; a call without a result has a null content; a dependency on an identifier that isn't there is ignored; calls with
a null conversation or identifier are left out; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondage.llm.common import Staging, small_batches

STRETCH = 256
_NOWHERE = 2**62
_TYPES = {
    "string": lambda x: isinstance(x, str),
    "integer": lambda x: isinstance(x, int) and not isinstance(x, bool) or isinstance(x, float) and x.is_integer(),
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
    "boolean": lambda x: isinstance(x, bool),
    "array": lambda x: isinstance(x, list),
    "object": lambda x: isinstance(x, dict),
    "null": lambda x: x is None,
}


def canonical(x: object) -> str:
    if isinstance(x, dict):
        keys = sorted(x, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(x[k])}" for k in keys) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(canonical, x)) + "]"
    if isinstance(x, float):
        return _number(x)
    return json.dumps(x, ensure_ascii=False, allow_nan=False)


def _number(x: float) -> str:
    """The shortest digits that give ``x``; exponents from 1e21 up and below 1e-6, without leading zeros."""
    if x != x or x in (float("inf"), float("-inf")):
        raise ValueError("not a JSON number")
    sign = "-" if x < 0 else ""
    mantissa, _, shift = repr(abs(x)).partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).strip("0") or "0"
    if digits == "0":
        return "0"
    # The value is 0.digits * 10 ** point.
    point = len(whole) + int(shift or 0) if whole != "0" else int(shift or 0) - (len(part) - len(part.lstrip("0")))
    if -6 < point <= 21:
        if point >= len(digits):
            return sign + digits + "0" * (point - len(digits))
        return sign + (digits[:point] + "." + digits[point:] if point > 0 else "0." + "0" * -point + digits)
    return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{point - 1:+d}"


def check_arguments(name: str | None, text: str | None, schemas: dict) -> tuple[str | None, list[str]]:
    """(canonical JSON, errors)."""
    try:
        value = json.loads(text) if text is not None else None
        form = canonical(value)
        form.encode()
    except (ValueError, RecursionError):  # a lone surrogate is no text either
        value = form = None
    if not isinstance(value, dict):
        return form if text is not None else None, ["malformed"]
    if name not in schemas:
        return form, ["unknown tool"]
    schema = schemas[name]
    errors = [f"missing {x}" for x in schema.get("required", []) if x not in value]
    for key in sorted(value):
        kind = schema.get("properties", {}).get(key)
        if kind is None:
            errors.append(f"unknown {key}")
        elif kind not in _TYPES:
            errors.append(f"{key} has the unknown type {kind}")
        elif not _TYPES[kind](value[key]):
            errors.append(f"{key} is not {kind}")
    return form, errors


def parse_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) from turns (conv_id, turn, role, text) whose text is JSON.

    Calls: assistant turns ``{"tool_calls": [{"id", "name", "arguments", "depends_on"}]}``. Results: tool turns
    ``{"tool_call_id", "content"}``. Other texts hold neither.
    """
    calls = F.from_json("text", "struct<tool_calls: array<struct<id: string, name: string, arguments: string, depends_on: array<string>>>>")
    calls = turns.where("role = 'assistant'").select("conv_id", "turn", F.explode(calls["tool_calls"]).alias("c"))
    calls = calls.select("conv_id", F.col("c.id").alias("call_id"), "turn", F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.depends_on").alias("depends_on"))
    result = F.from_json("text", "struct<tool_call_id: string, content: string>")
    results = turns.where("role = 'tool'").select("conv_id", result["tool_call_id"].alias("call_id"), "turn", result["content"].alias("content"))
    return calls, results.where("call_id is not null")


def turns_as_calls(turns: DataFrame, tool: str) -> tuple[DataFrame, DataFrame]:
    """Plain turns as calls of one tool: each user turn is a call, and the assistant turn after it is its result.

    The conversations hold no calls, so these are worked out from turn and length of the text, ``n``: the call depends on the next user turn's where n is a
    multiple of three, else on the one before, and where n is a multiple of four on that after the next one as well, so that dependencies are
    early, late, missing and circular. Arguments are {turn, prompt}; where n is a multiple of five, ``turn`` is a text, and of seven, ``prompt`` is
    absent; where n is a multiple of eleven, what is written isn't JSON.
    """
    call_id = lambda turn: F.concat(F.lit("t"), turn.cast("string"))
    text = F.coalesce("text", F.lit(""))
    n, turn = F.length(text), F.col("turn").cast("long")
    user = turns.where("role = 'user'")
    own = F.when(n % 5 == 0, F.concat(F.lit('"'), turn.cast("string"), F.lit('"'))).otherwise(turn.cast("string"))
    prompt = F.when(n % 7 != 0, F.expr("substring(to_json(named_struct('prompt', coalesce(text, ''))), 2)"))  # without its brace
    arguments = F.when(n % 11 == 0, F.lit("{turn")).otherwise(F.concat(F.lit('{"turn":'), own, F.coalesce(F.concat(F.lit(","), prompt), F.lit("}"))))
    needs = F.array_compact(F.array(call_id(F.when(n % 3 == 0, turn + 2).otherwise(turn - 2)), F.when(n % 4 == 0, call_id(turn + 4))))
    calls = user.select("conv_id", call_id(turn).alias("call_id"), turn.alias("turn"), F.lit(tool).alias("name"), arguments.alias("arguments"), needs.alias("depends_on"))
    answers = turns.where("role = 'assistant'")
    return calls, answers.select("conv_id", call_id(F.col("turn").cast("long") - 1).alias("call_id"), "turn", F.col("text").alias("content"))


def _places(calls: DataFrame, stage: Staging) -> DataFrame:
    """(conv_id, call_id, place, step): both null on or behind a cycle.

    Calls are peeled: those without open dependencies get their place and no longer hold up others. A round is a few jobs over what is still
    open, and there are as many as the longest chain of dependencies that aren't earlier is long; what a round can't peel hangs on a cycle.
    """
    at = calls.select("conv_id", "call_id", F.col("turn").cast("long").alias("place"), F.lit(0).cast("long").alias("step"))
    edges = calls.select("conv_id", "call_id", "turn", F.explode("depends_on").alias("needs")).distinct()
    known = calls.select("conv_id", F.col("call_id").alias("needs"), F.col("turn").alias("before"))
    edges = stage.put(edges.join(known, ["conv_id", "needs"]), "edges")
    # Whatever depends, over any number of steps, on a call with a later dependency may have to move.
    moving = stage.put(edges.where("before >= turn").select("conv_id", "call_id").distinct(), "moving")
    fresh = moving
    while not fresh.isEmpty():
        behind = edges.join(fresh.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left_semi").select("conv_id", "call_id").distinct()
        fresh = stage.put(behind.join(moving, ["conv_id", "call_id"], "left_anti"), "behind")
        moving = stage.put(moving.union(fresh), "moving")
    if moving.isEmpty():
        return at
    links = stage.put(edges.join(moving, ["conv_id", "call_id"], "left_semi").select("conv_id", "call_id", "needs"), "links")
    done = stage.put(at.join(moving, ["conv_id", "call_id"], "left_anti"), "settled")
    while True:
        # The dependencies of an open call that have a place, against all of them.
        placed = done.select("conv_id", F.col("call_id").alias("needs"), F.col("place").alias("p"), F.col("step").alias("s"))
        ready = links.join(placed, ["conv_id", "needs"], "left").groupBy("conv_id", "call_id").agg(F.count("*").alias("k"), F.count("p").alias("have"), F.max(F.struct("p", (F.col("s") + 1).alias("s"))).alias("m"))
        ready = ready.where("k = have").select("conv_id", "call_id", "m")
        own = at.join(ready, ["conv_id", "call_id"])
        later = F.col("m") > F.struct(F.col("place").alias("p"), F.col("step").alias("s"))
        own = stage.put(own.select("conv_id", "call_id", F.when(later, F.col("m.p")).otherwise(F.col("place")).alias("place"), F.when(later, F.col("m.s")).otherwise(F.col("step")).alias("step")), "ready")
        if own.isEmpty():
            break
        done = stage.put(done.union(own), "settled")
        links = stage.put(links.join(own, ["conv_id", "call_id"], "left_anti"), "links")
    stuck = links.select("conv_id", "call_id").distinct()
    return done.union(stuck.select("conv_id", "call_id", F.lit(None).cast("long"), F.lit(None).cast("long")))


def linked(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """(conv_id, call_id, turn, name, topo_rank, cyclic, result_turn, content, canonical, errors) of each call."""
    stage = Staging(calls.sparkSession, "calls")
    small_batches(calls.sparkSession)
    calls = calls.where("conv_id is not null and call_id is not null").withColumn("turn", F.coalesce(F.col("turn").cast("long"), F.lit(0)))
    calls = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("c")).select("conv_id", "call_id", "c.*")
    calls = stage.put(calls, "calls")
    results = results.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct(F.col("turn").alias("result_turn"), "content")).alias("r"))

    def validate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            got = [check_arguments(n, a, schemas) for n, a in zip(x.column("name").to_pylist(), x.column("arguments").to_pylist(), strict=True)]
            form, errors = zip(*got, strict=True) if got else ((), ())
            yield pa.RecordBatch.from_arrays([x.column(c) for c in ("conv_id", "call_id", "turn", "name")] + [pa.array(form, pa.string()), pa.array(errors, pa.list_(pa.string()))], ["conv_id", "call_id", "turn", "name", "canonical", "errors"])

    checked = calls.select(F.col("conv_id").cast("long").alias("conv_id"), "call_id", "turn", "name", "arguments").mapInArrow(validate, "conv_id long, call_id string, turn long, name string, canonical string, errors array<string>")
    places = _places(calls.select("conv_id", "call_id", "turn", "depends_on"), stage)
    rows = checked.join(places, ["conv_id", "call_id"]).join(results, ["conv_id", "call_id"], "left").select("*", "r.*").drop("r")
    rows = stage.put(rows.withColumn("cyclic", F.col("place").isNull()).withColumn("stretch", F.floor(F.coalesce("place", F.lit(_NOWHERE)) / STRETCH)), "rows")
    counts = rows.groupBy("conv_id", "stretch").agg(F.count("*").alias("n"))
    before = counts.select("conv_id", "stretch", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("stretch")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "stretch").orderBy(F.col("place").asc_nulls_last(), "step", "turn", "call_id"))
    rows = rows.withColumn("inside", inside).join(before, ["conv_id", "stretch"])
    return rows.select("conv_id", "call_id", "turn", "name", (F.col("before") + F.col("inside")).cast("long").alias("topo_rank"), "cyclic", "result_turn", "content", "canonical", "errors")
