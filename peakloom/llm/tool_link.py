"""Tool-call linking: calls and results meet by identifier, are ordered by dependency, checked against schemas and written as canonical JSON.

Plan: calls and results are hash-joined on (conversation, call id), with the calls, and then the results reduced to the
first of each call (map-side combine), as the built side: a row per call, so that no key's rows are many. Dependencies are levelled for all conversations at once, by joins, so that none is gathered in one
task: chains of calls with one dependency each by pointer jumping, in rounds as many as the logarithm of their length;
calls with several in rounds as many as such calls lie on one path. Arguments are validated row by row (narrow).

Edge cases: a call id given twice in a conversation: the first turn's call counts, later ones are status 'duplicate'; a
call without a result: 'no result'; a result without a call, or before it: not linked, and in unlinked_results; calls in a
cycle, or after one, have level null and status 'cycle'; dependencies on unknown calls are ignored; arguments that
aren't JSON (NaN, infinite numbers, lone surrogates and nesting too deep to read included), or break the schema: 'invalid'
with the first reason; enum compares type and value (true isn't 1, 1.0 is); a name without schema: 'unknown tool'; null ids link
to nothing; repeated rows count once; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, by_arrow, columns, discard, materialise

_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, int | float) and not isinstance(value, bool)
    return isinstance(value, _KINDS[kind])


def same(a, b) -> bool:
    """Equality of JSON values: numbers by value, never equal to booleans."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, int | float) and isinstance(b, int | float):
        return a == b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    return type(a) is type(b) and a == b


def _no_json(text: str):
    raise ValueError(f"{text} isn't JSON")


def _finite(text: str) -> float:
    got = float(text)
    return got if abs(got) != float("inf") else _no_json(text)


def read(text: str | None):
    """The JSON value of text; ValueError where it has none that can be written as JSON again."""
    try:
        value = json.loads(text or "", parse_constant=_no_json, parse_float=_finite)
        canonical(value).encode()
    except RecursionError:
        raise ValueError("nested too deeply") from None
    return value


def fault(value, schema: dict, at: str = "$") -> str | None:
    """The first breach of a JSON schema: type, enum, bounds, lengths, items, properties, required, additionalProperties."""
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{at}: type"
    if "enum" in schema and not any(same(value, x) for x in schema["enum"]):
        return f"{at}: enum"
    if isinstance(value, int | float) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            return f"{at}: minimum"
        if value > schema.get("maximum", value):
            return f"{at}: maximum"
    if isinstance(value, str | list):
        low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        if len(value) < schema.get(low, 0):
            return f"{at}: {low}"
        if len(value) > schema.get(high, len(value)):
            return f"{at}: {high}"
    if isinstance(value, list) and "items" in schema:
        return next((f for i, x in enumerate(value) if (f := fault(x, schema["items"], f"{at}[{i}]"))), None)
    if isinstance(value, dict):
        if missing := sorted(set(schema.get("required", ())) - value.keys()):
            return f"{at}.{missing[0]}: required"
        known = schema.get("properties", {})
        for k in sorted(value):
            if k in known:
                if f := fault(value[k], known[k], f"{at}.{k}"):
                    return f
            elif schema.get("additionalProperties") is False:
                return f"{at}.{k}: additional"
    return None


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _chains(edges: DataFrame) -> DataFrame:
    """Of calls with one dependency each, (conv_id, call_id, head, dist): the first call up their chain that hasn't one, by
    pointer jumping, in as many rounds as the logarithm of the longest chain. Chains into a cycle keep none."""
    key = ["conv_id", "call_id"]
    at = materialise(edges.select(*key, F.col("dep").alias("head"), F.lit(1).cast("bigint").alias("dist")), "chains")
    last = edges.select(*key)
    left, rounds = at.count(), 0
    while left and 2**rounds <= 2 * left:
        up = at.select("conv_id", F.col("call_id").alias("head"), F.col("head").alias("next"), F.col("dist").alias("more"))
        jumped = at.join(up, ["conv_id", "head"], "left").select(*key, F.coalesce("next", "head").alias("head"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"))
        before, at, rounds = at, materialise(jumped, "chains"), rounds + 1
        discard(before)
        if at.join(last.withColumnRenamed("call_id", "head"), ["conv_id", "head"], "left_semi").isEmpty():
            break
    return at.join(last.withColumnRenamed("call_id", "head"), ["conv_id", "head"], "left_anti")


def levels(calls: DataFrame) -> DataFrame:
    """calls: (conv_id, call_id, after). (conv_id, call_id, level), level from 0, null in or after a cycle."""
    key = ["conv_id", "call_id"]
    edges = calls.select(*key, F.explode(F.array_distinct("after")).alias("dep"))
    known = calls.select("conv_id", F.col("call_id").alias("dep"))
    edges = materialise(edges.join(known, ["conv_id", "dep"], "left_semi"), "call_edges")
    degree = materialise(edges.groupBy(*key).agg(F.count("*").alias("degree")), "degrees")
    chains = materialise(_chains(edges.join(degree.filter("degree = 1").select(*key), key, "left_semi")), "chains")
    level = lambda x: F.lit(x).cast("bigint").alias("level")
    done = calls.select(*key).join(degree, key, "left_anti").select(*key, level(0))
    waiting = degree.filter("degree > 1").select(*key)
    if not waiting.isEmpty():
        # calls with several dependencies: a round levels those all of whose chains end at a levelled call
        of = edges.join(waiting, key, "left_semi").join(chains.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"], "left")
        single = degree.filter("degree = 1").select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("single"))
        of = of.join(single, ["conv_id", "dep"], "left").select(*key, F.when(F.col("single").isNull(), F.col("dep")).otherwise(F.col("head")).alias("head"), F.coalesce("dist", F.lit(0)).alias("dist"))
        of = materialise(of, "junctions")
        done = materialise(done, "levels")
        while True:
            met = of.join(waiting, key, "left_semi").join(done.withColumnRenamed("call_id", "head"), ["conv_id", "head"], "left")
            ready = met.groupBy(*key).agg(F.max(F.col("level") + F.col("dist") + 1).alias("level"), F.count("*").alias("all"), F.count("level").alias("met"))
            ready = materialise(ready.filter(F.col("all") == F.col("met")).select(*key, "level"), "levels")
            if ready.isEmpty():
                break
            done = done.unionByName(ready)
            before, waiting = waiting, materialise(waiting.join(ready, key, "left_anti"), "waiting")
            discard(before)
    along = chains.join(done.select("conv_id", F.col("call_id").alias("head"), "level"), ["conv_id", "head"]).select(*key, (F.col("level") + F.col("dist")).alias("level"))
    return calls.select(*key).join(done.unionByName(along), key, "left").select(*key, F.col("level").cast("int"))


def _serialise(schemas: dict[str, dict]):
    out = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("call_id", pa.string()), ("level", pa.int32()), ("status", pa.string()), ("json", pa.string())])

    def run(batches):
        for b in batches:
            status, texts = [], []
            for r in b.to_pylist():
                try:
                    arguments = read(r["arguments"])
                    why = "unknown tool" if r["name"] not in schemas else (f := fault(arguments, schemas[r["name"]])) and f"invalid {f}"
                except ValueError:
                    arguments, why = None, "invalid $: JSON"
                status.append("duplicate" if r["duplicate"] else "cycle" if r["level"] is None else why or ("ok" if r["result_turn"] is not None else "no result"))
                result = None if r["result_turn"] is None else {"content": r["content"], "turn": r["result_turn"]}
                texts.append(canonical({"arguments": arguments, "id": r["call_id"], "name": r["name"], "result": result}))
            yield batch(out, b.column("conv_id"), b.column("turn"), b.column("call_id"), b.column("level"), status, texts)

    return run


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls: (conv_id, turn, call_id, name, arguments, after); results: (conv_id, turn, call_id, content); schemas by tool name.

    (conv_id, turn, call_id, level, status, json) of every call; ordering by level and turn is a topological order."""
    calls = columns(calls, conv_id="conv_id", turn="turn", call_id="call_id", name="name", arguments="arguments", after="after").distinct()
    key = ["conv_id", "call_id"]
    first = calls.filter("conv_id is not null and call_id is not null").groupBy(*key).agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("c"))
    first = materialise(first.select(*key, "c.turn", "c.name", "c.arguments", "c.after"), "calls")
    replies = columns(results, conv_id="conv_id", call_id="call_id", result_turn="turn", content="content")
    replies = replies.join(first.select(*key, "turn").hint("shuffle_hash"), key).filter("result_turn > turn").groupBy(*key).agg(F.min(F.struct("result_turn", "content")).alias("r"))
    replies = replies.select(*key, "r.result_turn", "r.content")
    kept = first.join(levels(first), key).join(replies.hint("shuffle_hash"), key, "left").withColumn("duplicate", F.lit(False))
    same = [calls[c].eqNullSafe(first[c]) for c in ("conv_id", "call_id", "turn", "name", "arguments", "after")]
    again = calls.join(first, same[0] & same[1] & same[2] & same[3] & same[4] & same[5], "left_anti")
    none = {"level": "int", "result_turn": "bigint", "content": "string"}
    again = again.select("*", *[F.lit(None).cast(t).alias(c) for c, t in none.items()], (F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).alias("duplicate"))
    again = again.withColumn("level", F.when(~F.col("duplicate"), 0))
    rows = kept.select("conv_id", "turn", "call_id", "name", "arguments", "level", "result_turn", "content", "duplicate")
    rows = rows.unionByName(again.select(*rows.columns))
    return by_arrow(rows, _serialise(schemas), "conv_id bigint, turn bigint, call_id string, level int, status string, json string")


def unlinked_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose identifier no earlier turn of their conversation has called."""
    first = calls.groupBy("conv_id", "call_id").agg(F.min("turn").alias("called"))
    return results.join(first, ["conv_id", "call_id"], "left").filter("called is null or turn <= called").drop("called")
