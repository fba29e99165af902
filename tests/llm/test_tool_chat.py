import itertools
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tramline.llm import tool_chat

SCHEMA = "conv_id long, turn int, role string, text string, role_ string"
TOOLS = json.dumps({"tools": [{"name": "add", "parameters": {"type": "object", "properties": {"a": {"type": "integer", "minimum": 0}, "b": {}}, "required": ["a"], "additionalProperties": False}}]})


def call(i, arguments, name="add"):
    return {"id": i, "name": name, "arguments": arguments}


def test_linked_ordered_and_validated(spark):
    calls = {"tool_calls": [call("c", {"a": 1, "b": {"$ref": "a"}}), call("a", {"a": -1}), call("x", {"z": 1})]}
    rows = [(1, 0, "system", TOOLS), (1, 1, "user", "hi é"), (1, 2, "assistant", json.dumps(calls)), (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": {"k": [1]}})), (1, 4, "tool", json.dumps({"tool_call_id": "no", "content": 1}))]
    row = tool_chat.formatted(spark.createDataFrame([(*r, "x") for r in reversed(rows)], SCHEMA)).first()
    out = json.loads(row.json)
    assert [s["id"] for s in out["steps"]] == ["a", "c", "x"]
    assert (row.n_calls, row.n_linked, row.n_invalid, row.n_cyclic, row.n_orphans) == (3, 1, 2, 0, 1)
    assert out["steps"][0]["errors"] == ["$.a: minimum"] and out["steps"][2]["errors"] == ["$.a: required", "$.z: additional"]
    assert out["steps"][0]["result"] == {"k": [1]} and row.json == tool_chat.canonical(out) and "é" in row.json


def test_cycles_come_last(spark):
    calls = {"tool_calls": [call("a", {"b": {"$ref": "b"}}), call("b", {"b": {"$ref": "a"}}), call("d", {"b": {"$ref": "gone"}})]}
    row = tool_chat.formatted(spark.createDataFrame([(1, 0, "assistant", json.dumps(calls), "")], SCHEMA)).first()
    assert row.n_cyclic == 2 and [s["id"] for s in json.loads(row.json)["steps"]] == ["d", "a", "b"]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5).flatmap(lambda n: st.lists(st.sets(st.integers(0, n - 1)), min_size=n, max_size=n)))
def test_order_against_all_orders(needs):
    order, cyclic = tool_chat.ordered(needs)
    assert sorted(order + cyclic) == list(range(len(needs)))
    rest = [i for i in range(len(needs)) if i in order]
    valid = [p for p in itertools.permutations(rest) if all(needs[x] <= set(p[:i]) for i, x in enumerate(p))]
    assert tuple(order) == min(valid)
    assert all(any(j in cyclic for j in needs[i]) for i in cyclic)


def test_blocks_and_repeated_identifiers(spark):
    text = "<tool_call>" + json.dumps(call("i", {})) + "</tool_call> and <tool_call>not json</tool_call><tool_call>" + json.dumps({"id": "i", "function": {"name": "f", "arguments": '{"q": 1}'}}) + "</tool_call>"
    rows = [(1, 0, "assistant", text), (1, 1, "tool", '{"tool_call_id": "i", "content": "one"}'), (1, 2, "tool", '{"tool_call_id": "i", "content": "two"}')]
    out = json.loads(tool_chat.formatted(spark.createDataFrame([(*r, "") for r in rows], SCHEMA)).first().json)
    assert [(s["name"], s["result"]) for s in out["steps"]] == [("add", "one"), ("f", "two")]


def test_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (1, None, None, None), (1, None, None, None), (1, 0, "user", "{broken"), (1, 0, "assistant", '{"tool_calls": [{"name": 3}, 7, {"name": "f", "arguments": "[]"}]}'), (2, 0, "user", "long " * 10_000), (3, 1, "tool", "{}"), (4, 0, "assistant", '{"tool_calls": NaN}')]
    got = {r.conv_id: r for r in tool_chat.formatted(spark.createDataFrame([(*r, "") for r in rows], SCHEMA)).collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[1].n_messages == 3 and got[1].n_calls == 1 and got[1].n_invalid == 1
    assert json.loads(got[1].json)["messages"][0] == {"role": "", "content": ""} and len(json.loads(got[2].json)["messages"][0]["content"]) == 50_000
    assert tool_chat.formatted(spark.createDataFrame([], SCHEMA)).collect() == []


def test_plain_conversations_against_a_second_reading(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t} \"q\" \n") for c in range(50) for t in range(c % 7 + 1)]
    got = {r.conv_id: r.json for r in tool_chat.formatted(spark.createDataFrame([(*r, "") for r in rows], SCHEMA).repartition(5)).collect()}
    for c in range(50):
        own = [{"content": x[3], "role": x[2]} for x in sorted(r for r in rows if r[0] == c)]
        assert got[c] == json.dumps({"conv_id": c, "messages": own}, separators=(",", ":"), sort_keys=True, ensure_ascii=False)
