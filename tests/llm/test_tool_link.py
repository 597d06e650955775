import json

from peakloom.llm.queries import OP6_SQL, op6_tool_call_linking
from peakloom.llm.tool_link import fault, link_calls, unlinked_results

from .helpers import of, oracle

CALLS = "conv_id bigint, turn bigint, call_id string, name string, arguments string, after array<string>"
RESULTS = "conv_id bigint, turn bigint, call_id string, content string"


def test_against_sql(spark, sf):
    assert of(op6_tool_call_linking(spark, sf)) == oracle(OP6_SQL, sf)


def test_links_orders_and_validates(spark):
    schema = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 1}}, "additionalProperties": False}}
    calls = [(1, 5, "c", "f", '{"x": 2}', ["b", "a", "zz"]), (1, 0, "a", "f", '{"x":1}', []), (1, 2, "b", "f", '{ "x":0}', ["a"]), (1, 7, "a", "f", '{"x":9}', None), (2, 0, "a", "f", "{", None), (2, 1, "p", "f", '{"x":1,"y":"é\\n"}', ["q"]), (2, 2, "q", "f", '{"x":1}', ["p"]), (2, 3, "r", "g", "{}", ["q"]), (3, 0, "a", "f", '{"x":"1"}', None), (None, 0, "a", "f", '{"x":1}', None), (4, 0, None, "f", None, None), (1, 0, "a", "f", '{"x":1}', [])]
    results = [(1, 6, "c", "late"), (1, 9, "c", "later"), (1, 1, "a", "é"), (2, 9, "nobody", "x"), (3, 0, "a", "same turn"), (None, 1, "a", "x"), (1, 3, "b", None)]
    c, r = spark.createDataFrame(calls, CALLS).selectExpr("*", "1 AS level"), spark.createDataFrame(results, RESULTS)
    got = {(x.conv_id, x.turn, x.call_id): (x.level, x.status, json.loads(x.json)["result"]) for x in link_calls(c, r, schema).collect()}
    assert got == {
        (1, 0, "a"): (0, "ok", {"content": "é", "turn": 1}),
        (1, 2, "b"): (1, "invalid $.x: minimum", {"content": None, "turn": 3}),
        (1, 5, "c"): (2, "ok", {"content": "late", "turn": 6}),
        (1, 7, "a"): (None, "duplicate", None),
        (2, 0, "a"): (0, "invalid $: JSON", None),
        (2, 1, "p"): (None, "cycle", None),
        (2, 2, "q"): (None, "cycle", None),
        (2, 3, "r"): (None, "cycle", None),
        (3, 0, "a"): (0, "invalid $.x: type", None),
        (None, 0, "a"): (0, "no result", None),
        (4, 0, None): (0, "invalid $: JSON", None),
    }
    assert {(x.conv_id, x.turn, x.call_id) for x in unlinked_results(c, r).collect()} == {(2, 9, "nobody"), (3, 0, "a"), (None, 1, "a")}
    assert link_calls(c.limit(0), r, schema).count() == 0 and link_calls(c, r.limit(0), schema).count() == 11


def test_levels_against_brute_force(spark):
    import random

    from peakloom.llm.tool_link import levels

    rnd, rows = random.Random(6), []
    for conv in range(6):
        for k in range(40):
            after = [str(k - 1)] if conv < 2 and k else [str(rnd.randrange(k + 1 if conv == 5 else k)) for _ in range(rnd.choice([0, 1, 1, 1, 2]))] if k else []
            rows.append((conv, str(k), after or None))
    want = {}
    for conv, k, after in rows:  # dependencies come first, but in conversation 5 some calls wait for themselves
        deps = [want.get((conv, d)) for d in set(after or ())]
        want[conv, k] = None if k in (after or ()) or None in deps else max(deps, default=-1) + 1
    got = levels(spark.createDataFrame(rows, "conv_id bigint, call_id string, after array<string>")).collect()
    assert {(r.conv_id, r.call_id): r.level for r in got} == want


def test_faults():
    s = {"type": "array", "items": {"type": ["string", "null"], "maxLength": 2}, "maxItems": 2}
    assert [fault(x, s) for x in (["a", None], ["abc"], [1], "x", [None] * 3)] == [None, "$[0]: maxLength", "$[0]: type", "$: type", "$: maxItems"]
    assert fault(True, {"type": "integer"}) == "$: type" and fault("b", {"enum": ["a"]}) == "$: enum" and fault(2.0, {"type": "integer", "maximum": 1}) == "$: maximum"


def test_values_are_compared_as_json(spark):
    from peakloom.llm.tool_link import canonical, read, same

    assert fault(True, {"enum": [1]}) == "$: enum" and fault(1.0, {"enum": [1]}) is None and fault([{"a": 0}], {"enum": [[{"a": False}]]}) == "$: enum"
    assert same({"a": [1, None]}, {"a": [1.0, None]}) and not same("1", 1)
    for text in ('{"x":NaN}', "Infinity", "[1e400]", '"\\ud800"', "[" * 100_000, "", None):
        try:
            raise AssertionError(read(text))
        except ValueError:
            pass
    assert canonical(read('{"b":1e3,"a":"é"}')) == '{"a":"é","b":1000.0}'
    rows = [(1, 0, "a", "f", '{"x":NaN}', None), (1, 1, "b", "f", "[1e400]", None), (1, 2, "c", "f", "[" * 50_000, None), (1, 3, "d", "f", '"' + "x" * 3_000_000 + '"', None)]
    c, r = spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS)
    got = {x.call_id: (x.status, x.json) for x in link_calls(c, r, {"f": {}}).collect()}
    assert [got[k][0] for k in "abcd"] == ["invalid $: JSON"] * 3 + ["no result"] and len(got["d"][1]) > 3_000_000
    assert got["a"][1] == '{"arguments":null,"id":"a","name":"f","result":null}'


def test_identifiers_meet_by_hash_join_and_long_chains_are_levelled(spark):
    from peakloom.llm.tool_link import levels

    rows = [(1, k, str(k), "f", "{}", [str(k - 1)]) for k in range(700)]
    calls, results = spark.createDataFrame(rows, CALLS), spark.createDataFrame([(1, 900, "5", "x")], RESULTS)
    assert {int(r.call_id): r.level for r in levels(calls).collect()} == {k: k for k in range(700)}
    assert "ShuffledHashJoin" in link_calls(calls, results, {"f": {}})._jdf.queryExecution().toString()
