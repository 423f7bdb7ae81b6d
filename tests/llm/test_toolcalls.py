import json
import random

import pytest

from lodestone.llm import toolcalls

SCHEMAS = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["number", "null"]}}, "additionalProperties": False}}
COLUMNS = "conv_id long, turn long, role string, text string, wave string, place int"


def call(i, args, needs=(), name="add"):
    return {"id": i, "name": name, "arguments": args, "depends_on": list(needs)}


def run(spark, messages):
    df = spark.createDataFrame([(*m[:3], m[3] if m[3] is None or isinstance(m[3], str) else json.dumps(m[3]), "x", 1) for m in messages], COLUMNS)
    calls, results = toolcalls.parse(df)
    return {(r.conv_id, r.call_id, r.turn): r for r in toolcalls.link(calls, results, SCHEMAS).collect()}, toolcalls.orphans(calls, results).collect()


def test_links_statuses_and_canonical_json(spark):
    rows, lost = run(
        spark,
        [
            (1, 0, "user", "please"),
            (1, 1, "assistant", {"tool_calls": [call("x", {"b": 2.0, "a": 1}), call("y", {"a": -1}), call("z", {"a": 1}, name="sub"), call("w", "{bad")]}),
            (1, 2, "tool", {"tool_call_id": "x", "content": {"k": "é", "a": 1}}),
            (1, 3, "tool", {"tool_call_id": "x", "content": "later"}),
            (1, 4, "tool", {"tool_call_id": "nobody", "content": "?"}),
            (1, 5, "assistant", {"tool_calls": [call("x", {"a": 2}), call("v", {"a": 1}, ["x", "gone"]), call("u", {"a": 3}, ["x"])]}),
            (2, 1, "assistant", {"tool_calls": [call("x", {"a": 5}), call(None, {"a": 5})]}),
            (2, 2, "assistant", None),
            (2, 3, "assistant", ""),
            (2, 4, "assistant", "[1, 2]"),
            (None, 1, "assistant", {"tool_calls": [call("x", {"a": 5})]}),
        ],
    )
    assert rows[1, "x", 1].json == '{"arguments":{"a":1,"b":2},"call_id":"x","depends_on":[],"name":"add","result":"{\\"a\\":1,\\"k\\":\\"é\\"}"}'
    status = {k: r.status for k, r in rows.items()}
    assert status == {(1, "x", 1): "ok", (1, "y", 1): "invalid_arguments", (1, "z", 1): "unknown_tool", (1, "w", 1): "invalid_arguments", (1, "x", 5): "duplicate", (1, "v", 5): "missing_dependency", (1, "u", 5): "no_result", (2, "x", 1): "no_result", (2, None, 1): "no_id", (None, "x", 1): "no_id"}
    assert rows[1, "w", 1].json is None and [r.call_id for r in lost] == ["nobody"]


def test_order_is_topological_and_cycles_are_named(spark):
    needs = {"a": ["d"], "b": ["a"], "c": [], "d": ["e"], "e": [], "f": ["g"], "g": ["f"], "h": ["f"], "i": ["c"]}
    rows, _ = run(spark, [(7, 1, "assistant", {"tool_calls": [call(k, {"a": 1}, v) for k, v in needs.items()]}), (8, 1, "assistant", {"tool_calls": [call("a", {"a": 1}), call("b", {"a": 1}, ["a"])]})])
    by = {k[1]: r for k, r in rows.items() if k[0] == 7}
    order = sorted((r.wave, r.turn, r.place, k) for k, r in by.items() if r.status != "cycle")
    seen = set()
    for *_, k in order:
        assert set(needs[k]) <= seen
        seen.add(k)
    assert {k for k, r in by.items() if r.status == "cycle"} == {"f", "g", "h"}
    assert {r.wave for k, r in rows.items() if k[0] == 8} == {0}


@pytest.mark.parametrize(
    ("value", "schema", "bad"),
    [
        (1, {"type": "integer"}, 0), (True, {"type": "integer"}, 1), (1.5, {"type": "integer"}, 1), (2.0, {"type": "integer"}, 0), ("x", {"enum": ["y"]}, 1),
        ([1, "a"], {"items": {"type": "number"}}, 1), ({"a": 1}, {"required": ["b"]}, 1), ("", {"minLength": 1}, 1), (5, {"maximum": 4}, 1), (None, {"type": ["string", "null"]}, 0),
    ],
)
def test_schema_rules(value, schema, bad):
    assert len(toolcalls.violations(value, schema)) == bad


def test_plain_conversations(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "p"), (1, 2, "assistant", "q"), (1, 3, "user", ""), (1, 3, "user", "r"), (None, 1, "user", "t"), (2, None, "user", "t"), (3, 0, "user", None)]
    calls, results = toolcalls.as_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {(r.conv_id, r.turn, r.status): r for r in toolcalls.link(calls, results, toolcalls.REPLY).collect()}
    assert set(out) == {(1, 1, "ok"), (1, 3, "invalid_arguments"), (1, 3, "duplicate"), (3, 0, "invalid_arguments")}
    assert json.loads(out[1, 3, "duplicate"].json)["depends_on"] == ["1-1"]
    calls, results = toolcalls.as_calls(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert toolcalls.link(calls, results, toolcalls.REPLY).collect() == []


def test_canonical_is_total():
    deep = "[" * 1500 + "]" * 1500
    for text in ('{"a":1e400}', '{"a":-1e400}', '{"a":NaN}', "[" * 200_000):
        assert isinstance(toolcalls.parsed(text), ValueError)
    for text in (deep, '{"a":' * 1500 + "1" + "}" * 1500, '"\\ud800x"', '{"\\udfff":"\\ud83d\\ude00"}', "123456789" * 100, "1e300", "[-0.0,0.1,2.0]", '{"b":[],"a":{}}'):
        value = toolcalls.parsed(text)
        told = toolcalls.canonical(value)
        told.encode()
        assert toolcalls.canonical(json.loads(told)) == told
        if len(text) < 1000:
            assert json.loads(told) == value
    assert toolcalls.canonical([2.0, -0.0, {"b": 1, "a": "é"}]) == '[2,0,{"a":"é","b":1}]'
    assert toolcalls.violations(10**400, {"type": "integer", "maximum": 5}) == ["$: high"]


def test_messages_that_no_text_column_can_hold(spark):
    odd = ['{"a":1e400}', '"\\ud800"', "[" * 1500 + "]" * 1500, "z" * 300_000]
    calls = {"tool_calls": [{"id": f"c{i}", "name": "add", "arguments": a} for i, a in enumerate(odd)] + [{"id": "\ud800", "name": "\udfff", "arguments": {"a": 1}, "depends_on": ["\ud800", None, 3]}]}
    rows, _ = run(spark, [(1, 1, "assistant", calls), (1, 2, "tool", {"tool_call_id": "c0", "content": "\ud800"})])
    assert {r.status for r in rows.values()} == {"invalid_arguments", "unknown_tool"} and len(rows) == 5


def waves_of(needs):
    """wave of each call by plain recursion over positions; cycles and what hangs on them get none."""
    place = {c: i for i, c in enumerate(needs)}
    wave: dict = {}
    changed = True
    while changed:
        changed = False
        for c, ns in needs.items():
            if c not in wave and all(n in wave for n in ns):
                wave[c] = max((wave[n] + (place[n] >= place[c]) for n in ns), default=0)
                changed = True
    return wave


def test_waves_equal_brute_force(spark):
    rnd = random.Random(4)
    graphs = [{f"c{i}": [f"c{i + 1}"] if i < 200 else [] for i in range(201)}]
    for _ in range(6):
        names = [f"c{i}" for i in range(40)]
        rank = rnd.sample(range(40), 40)
        below = lambda i: [names[j] for j in rnd.sample(range(40), 3) if rank[j] < rank[i]]
        graphs.append({n: below(i) for i, n in enumerate(names)})
    graphs.append({"a": ["b"], "b": ["c"], "c": ["a"], "d": ["a", "e"], "e": ["f"], "f": []})
    messages = [(k, 1, "assistant", {"tool_calls": [call(c, {"a": 1}, ns) for c, ns in g.items()]}) for k, g in enumerate(graphs)]
    rows, _ = run(spark, messages)
    for k, g in enumerate(graphs):
        wave = waves_of(g)
        assert {c: r.wave for (conv, c, _), r in rows.items() if conv == k and r.status != "cycle"} == wave
