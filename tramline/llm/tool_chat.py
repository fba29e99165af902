"""Chat formatting with tool-call linking.

A conversation's rows come together by one shuffle on conv_id, sorted by turn. Tools are declared in messages of role
system or developer, as JSON {"tools": [{"name", "parameters"}]}. Calls are in assistant messages, as JSON {"tool_calls":
[{"id", "name", "arguments"}]} (also in the form {"id", "function": {"name", "arguments"}}) or between <tool_call> and
</tool_call>. Results are messages of role tool: JSON {"tool_call_id", "content"}. Calls and results are hash-joined by
identifier: the k-th result of an identifier belongs to its k-th call. A call depends on another one if its arguments
hold {"$ref": identifier}; calls are put in topological order, of those that are free the earliest first. Arguments are
validated against the declared JSON schema. The whole is serialised as canonical JSON: sorted keys, no spaces, no
escapes but those JSON needs.

Defined results. Rows without conv_id are left out. A repeated row counts once; rows of one turn are ordered by role
and text, null first. Null roles and texts are empty strings. Calls of a cycle come last in their own order and
count in n_cyclic, what depends on them as well. A reference to an identifier that no call has is no dependency. Calls of an
undeclared tool are invalid if the conversation declares any tool, and calls without an object of arguments are invalid.
Results without a call are listed as orphans. Malformed JSON is plain text: also that with numbers which are not
finite or which Python refuses, and that nested over DEPTH deep. Halves of surrogate pairs are escaped. A conversation is one row of the
result, so its messages meet in one task, whatever their number. An empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.shared import returning

#: JSON that is nested deeper is malformed.
DEPTH = 200
_LONE = re.compile("[\ud800-\udfff]")
_BLOCK = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
SCHEMA = "conv_id long, n_messages long, n_calls long, n_linked long, n_invalid long, n_cyclic long, n_orphans long, json string"


def canonical(value: object) -> str:
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _depth(text: str) -> int:
    """A bound on how deep the objects and lists of text are nested: brackets in strings count as well."""
    step = np.zeros(256, np.int8)
    step[[ord("["), ord("{")]], step[[ord("]"), ord("}")]] = 1, -1
    return int(np.cumsum(step[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)], dtype=np.int64).max(initial=0))


def _loads(text: str) -> object:
    def refuse(name: str) -> None:
        raise ValueError(name)

    def finite(digits: str) -> float:
        value = float(digits)
        return value if math.isfinite(value) else refuse(digits)

    if text.count("[") + text.count("{") > DEPTH and _depth(text) > DEPTH:
        return None
    try:
        return json.loads(text, parse_constant=refuse, parse_float=finite)
    except (ValueError, RecursionError):
        return None


def _is(value: object, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, int | float) and not isinstance(value, bool)
    types = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}
    return isinstance(value, types[kind]) if kind in types else True


def errors(value: object, schema: object, at: str = "$") -> list[str]:
    """Where value breaks schema: type, enum, const, bounds, lengths, required, properties, additionalProperties, items."""
    if not isinstance(schema, dict):
        return []
    kinds = schema.get("type")
    kinds = kinds if isinstance(kinds, list) else [kinds] if isinstance(kinds, str) else []
    if kinds and not any(_is(value, k) for k in kinds if isinstance(k, str)):
        return [f"{at}: type"]
    out = []
    if isinstance(schema.get("enum"), list) and not any(canonical(value) == canonical(x) for x in schema["enum"]):
        out.append(f"{at}: enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        out.append(f"{at}: const")
    if _is(value, "number"):
        out += [f"{at}: {k}" for k, bad in (("minimum", lambda b: value < b), ("maximum", lambda b: value > b)) if _is(schema.get(k), "number") and bad(schema[k])]
    if isinstance(value, str | list):
        low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        out += [f"{at}: {k}" for k, bad in ((low, lambda b: len(value) < b), (high, lambda b: len(value) > b)) if _is(schema.get(k), "number") and bad(schema[k])]
    if isinstance(value, list):
        for i, x in enumerate(value):
            out += errors(x, schema.get("items"), f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties") if isinstance(schema.get("properties"), dict) else {}
        required = schema.get("required") if isinstance(schema.get("required"), list) else []
        out += [f"{at}.{k}: required" for k in required if isinstance(k, str) and k not in value]
        for k in sorted(value):
            if k in known:
                out += errors(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: additional")
            else:
                out += errors(value[k], schema.get("additionalProperties"), f"{at}.{k}")
    return out


def references(value: object) -> set[str]:
    """The identifiers in {"$ref": identifier} anywhere in value."""
    found, stack = set(), [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if isinstance(x.get("$ref"), str):
                found.add(x["$ref"])
            stack.extend(x.values())
        elif isinstance(x, list):
            stack.extend(x)
    return found


def ordered(needs: list[set[int]]) -> tuple[list[int], list[int]]:
    """Nodes in topological order, the least free one first; and those that lie on a cycle or depend on one."""
    waiting, users = [len(n) for n in needs], defaultdict(list)
    for i, own in enumerate(needs):
        for j in own:
            users[j].append(i)
    free = [i for i, w in enumerate(waiting) if not w]
    heapq.heapify(free)
    order = []
    while free:
        i = heapq.heappop(free)
        order.append(i)
        for j in users[i]:
            waiting[j] -= 1
            if not waiting[j]:
                heapq.heappush(free, j)
    done = set(order)
    return order, [i for i in range(len(needs)) if i not in done]


def _call(x: object) -> dict | None:
    if not isinstance(x, dict):
        return None
    inner = x.get("function") if isinstance(x.get("function"), dict) else x
    if not isinstance(inner.get("name"), str):
        return None
    arguments = inner.get("arguments", {})
    if isinstance(arguments, str):
        arguments = _loads(arguments)
    return {"id": x["id"] if isinstance(x.get("id"), str) else "", "name": inner["name"], "arguments": arguments}


def conversation(conv_id: int, rows: list[tuple]) -> tuple:
    """The result's row of a conversation of (turn, role, text) in order."""
    messages, tools, calls, results = [], {}, [], defaultdict(deque)
    for _, role, text in rows:
        messages.append({"role": role, "content": text})
        whole = _loads(text) if text[:1] == "{" else None
        if role in ("system", "developer") and isinstance(whole, dict) and isinstance(whole.get("tools"), list):
            for tool in whole["tools"]:
                tool = tool.get("function", tool) if isinstance(tool, dict) else None
                if isinstance(tool, dict) and isinstance(tool.get("name"), str):
                    tools.setdefault(tool["name"], tool.get("parameters", {}))
        elif role == "assistant":
            listed = whole["tool_calls"] if isinstance(whole, dict) and isinstance(whole.get("tool_calls"), list) else [_loads(m.strip()) for m in _BLOCK.findall(text)] if "<tool_call>" in text else []
            calls += [c for c in map(_call, listed) if c]
        elif role == "tool" and isinstance(whole, dict) and isinstance(whole.get("tool_call_id"), str):
            results[whole["tool_call_id"]].append(whole.get("content"))
    first = {}
    for i, c in enumerate(calls):
        if c["id"]:
            first.setdefault(c["id"], i)
    linked = invalid = 0
    for c in calls:
        c["errors"] = ["$: type"] if not isinstance(c["arguments"], dict) else ["$: unknown tool"] if tools and c["name"] not in tools else errors(c["arguments"], tools.get(c["name"]))
        c["valid"] = not c["errors"]
        invalid += not c["valid"]
        c["linked"] = bool(c["id"] and results.get(c["id"]))
        if c["linked"]:
            c["result"] = results[c["id"]].popleft()
            linked += 1
    needs = [{first[r] for r in references(c["arguments"]) if r in first} for c in calls]
    order, cyclic = ordered(needs)
    orphans = [{"id": k, "content": x} for k in sorted(results) for x in results[k]]
    out = {"conv_id": conv_id, "messages": messages}
    if calls or orphans:
        out |= {"steps": [calls[i] for i in order + cyclic], "orphans": orphans}
    return conv_id, len(messages), len(calls), linked, invalid, len(cyclic), len(orphans), canonical(out)


def formatted(conversations: DataFrame) -> DataFrame:
    """One row for each conversation, see SCHEMA; json is the canonical form."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").cast("long").alias("turn"), text("role"), text("text")).where("conv_id is not null")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, size, current, own = [], 0, None, []

        def packed() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "json" else pa.int64()) for c, n in zip(columns, names, strict=True)], names)

        for batch in batches:
            for conv_id, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv_id != current:
                    if own:
                        done.append(conversation(current, own))
                        size += len(done[-1][-1])
                        if size > 4 << 20:
                            yield packed()
                            done, size = [], 0
                    current, own = conv_id, []
                if not own or own[-1] != row:
                    own.append(row)
        if own:
            done.append(conversation(current, own))
        if done:
            yield packed()

    return rows.mapInArrow(returning(run), SCHEMA)
