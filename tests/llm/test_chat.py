"""Calls, results, order, schemas and canonical JSON."""

import json
import random

import pytest

from quillspark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, call_id string, round int"


def messages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def call(i, name="add", args=None, after=()):
    return "text <tool_call>" + json.dumps({"id": i, "name": name, "arguments": {"b": 1, "a": 2} if args is None else args, "after": list(after)}) + "</tool_call> more"


def result(i, content):
    return json.dumps({"call_id": i, "content": content})


TOOLS = {"add": {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "integer", "maximum": 5}}, "required": ["a", "b"], "additionalProperties": False}}


def linked(spark, rows, schemas=TOOLS):
    return {(r["conv_id"], r["call_id"], r["status"], r["result_turn"]): r for r in chat.link(chat.events(messages(spark, rows)), schemas).collect()}


def test_links_order_and_checks(spark):
    got = linked(spark, [
        (1, 0, "assistant", call("x", after=["y"])), (1, 1, "assistant", call("y")), (1, 2, "tool", result("x", {"é": 1})), (1, 3, "tool", result("x", 2)),
        (1, 4, "tool", result("none", 3)), (1, 5, "assistant", call("z", args={"a": 1, "b": 9, "c": 0}, after=["x"])), (1, 6, "assistant", "<tool_call>{no}</tool_call>"), (1, 7, "tool", "not json"),
        (2, 0, "assistant", call("p", after=["q"])), (2, 1, "assistant", call("q", after=["p"])), (2, 2, "assistant", call("r", "unknown")), (2, 2, "assistant", call("r", "unknown")), (None, 1, "assistant", call("n")), (3, None, "tool", None),
    ])
    x = got[1, "x", "linked", 2]
    assert x["record"] == '{"arguments":{"a":2,"b":1},"copies":1,"id":"x","name":"add","result":{"é":1}}' and x["valid"]
    assert (1, "x", "linked", 3) in got and (1, "none", "orphan", 4) in got
    assert (got[1, "y", "unanswered", None]["round"], x["round"], got[1, "z", "unanswered", None]["round"]) == (0, 1, 1)
    assert got[1, "z", "unanswered", None]["errors"] == "$.b: out of range; $.c: unknown"
    assert got[2, "p", "unanswered", None]["round"] is None and got[2, "q", "unanswered", None]["round"] is None
    assert not got[2, "r", "unanswered", None]["valid"] and '"copies":2' in got[2, "r", "unanswered", None]["record"]
    assert sum(k[2] == "broken" for k in got) >= 2


def test_exchanges(spark):
    got = linked(spark, [(5, 0, "user", "hi"), (5, 1, "assistant", "hello"), (5, 2, "user", None), (5, 4, "assistant", "late"), (6, 0, "system", "")], chat.EXCHANGES)
    assert got[5, "0", "linked", 1]["valid"] and json.loads(got[5, "0", "linked", 1]["record"])["result"] == "hello"
    assert (5, "2", "unanswered", None) in got and (5, "3", "orphan", 4) in got and (6, "0", "unanswered", None) in got


def test_order_against_plain_relaxation(spark):
    r = random.Random(1)
    rows, after = [], {}
    for i in range(60):
        after[str(i)] = [str(j) for j in r.sample(range(60), 2) if j != i] if i % 3 == 0 else []
        rows.append((1, i, "assistant", call(str(i), after=after[str(i)])))
    got = {k[1]: v["round"] for k, v in linked(spark, rows).items()}
    most = sum(int(j) >= int(i) for i, a in after.items() for j in a)
    want = dict.fromkeys(after, 0)
    for _ in range(most + 62):
        want = {i: min(most + 1, max([want[i], *(want[j] + (int(j) >= int(i)) for j in a)])) for i, a in after.items()}
    assert got == {i: (w if w <= most else None) for i, w in want.items()}
    for i, a in after.items():
        if got[i] is not None:
            assert all((got[j], int(j)) < (got[i], int(i)) for j in a)


def test_empty(spark):
    assert chat.link(chat.events(messages(spark, []).limit(0)), {}).collect() == []


@pytest.mark.parametrize(("value", "schema", "wrong"), [(1.0, {"type": "integer"}, []), (True, {"type": "number"}, ["$: not number"]), ([1, "x"], {"type": "array", "items": {"type": "integer"}}, ["$[1]: not integer"]), ("a", {"enum": ["b"]}, ["$: not in enum"]), (None, {"type": "null"}, []), ({}, {"required": ["k"]}, ["$.k: missing"])])
def test_violations(value, schema, wrong):
    assert chat.violations(value, schema) == wrong


def plain_link(events, schemas):
    """All rows of link, from events as tuples (kind, conv, turn, call_id, name, arguments, after, content)."""
    calls, rows = {}, []
    for kind, conv, turn, call_id, name, arguments, after, _ in events:
        if kind == "call" and conv is not None and call_id is not None:
            calls.setdefault((conv, call_id), []).append((turn, arguments, name, tuple(after)))
        elif kind in ("call", "broken"):
            status = "unanswered" if kind == "call" else "broken"
            record, wrong = chat.canonical({"text": arguments}), f"$: {status}"
            if status == "unanswered":
                args, schema = json.loads(arguments), schemas.get(name)
                bad = chat.violations(args, schema) if schema else [f"$: unknown tool {name}"]
                record, wrong = chat.canonical({"arguments": args, "copies": None, "id": call_id, "name": name, "result": None}), "; ".join(bad)
            rows.append((conv, call_id if kind == "call" else None, turn, None, None, status, not wrong, wrong, record))
    first = {k: min(v, key=lambda c: (c[0] is not None, c[0] or 0, *c[1:])) for k, v in calls.items()}
    results = [(conv, call_id, turn, content) for kind, conv, turn, call_id, _, _, _, content in events if kind == "result"]
    for conv, call_id, turn, content in results:
        if (conv, call_id) not in first or conv is None or call_id is None:
            rows.append((conv, call_id, None, None, turn, "orphan", False, "$: orphan", chat.canonical({"id": call_id, "result": json.loads(content)})))
    for (conv, call_id), (turn, arguments, name, _) in first.items():
        args, schema = json.loads(arguments), schemas.get(name)
        bad = chat.violations(args, schema) if schema else [f"$: unknown tool {name}"]
        answers = [(t, c) for a, b, t, c in results if (a, b) == (conv, call_id)]
        for t, c in answers or [(None, None)]:
            record = chat.canonical({"arguments": args, "copies": len(calls[conv, call_id]), "id": call_id, "name": name, "result": None if c is None else json.loads(c)})
            rows.append((conv, call_id, turn, "round", t, "unanswered" if c is None else "linked", not bad, "; ".join(bad), record))
    return rows


def test_whole_records_against_a_plain_version(spark):
    r = random.Random(21)
    schemas = {"f": {"type": "object", "properties": {"n": {"type": "integer", "minimum": 0}}, "required": ["n"], "additionalProperties": False}, "g": {"type": "object"}}
    events = []
    for _ in range(400):
        conv, call_id, turn = r.choice([1, 2, 3, None]), r.choice(["a", "b", "c", "d", "e", None]), r.choice([0, 1, 2, 3, None])
        kind = r.choice(["call", "call", "result", "broken"])
        arguments = chat.canonical(r.choice([{"n": 1}, {"n": -1}, {"n": 1, "m": 2}, {}]))
        events.append((kind, conv, turn, call_id if kind != "broken" else None, r.choice(["f", "g", "h"]) if kind == "call" else None, arguments if kind == "call" else "[" if kind == "broken" else None, r.sample(["a", "b"], 1) if kind == "call" else [], chat.canonical([r.randint(0, 9)]) if kind == "result" else None))
    got = [(*x[:3], "round" if x["status"] in ("linked", "unanswered") and x["conv_id"] is not None and x["call_id"] is not None else None, *x[4:]) for x in map(tuple_of, chat.link(spark.createDataFrame(events, chat.EVENT), schemas).collect())]
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(got, key=key) == sorted(plain_link(events, schemas), key=key)


class tuple_of(tuple):
    """A row as a tuple that still knows its names."""

    names = ("conv_id", "call_id", "turn", "round", "result_turn", "status", "valid", "errors", "record")

    def __getitem__(self, i):
        return tuple.__getitem__(self, self.names.index(i) if isinstance(i, str) else i)


def test_open_tags_take_linear_time():
    import time

    began = time.time()
    assert list(chat._events(1, 0, "assistant", "<tool_call>" * 200_000)) == [("result", 1, 0, "-1", None, None, [], chat.canonical("<tool_call>" * 200_000))]
    assert chat._bodies("<tool_call>a<tool_call>b</tool_call></tool_call><tool_call>c</tool_call>") == ["a<tool_call>b", "c"] and time.time() - began < 5
