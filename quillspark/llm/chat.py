"""Tool-call linking: calls and results joined by identifier, put in topological order, checked against schemas, written
as canonical JSON.

Messages (conv_id, turn, role, text) hold calls as `<tool_call>{"id", "name", "arguments", "after"}</tool_call>` in any
text and results as messages of role `tool` whose text is `{"call_id", "content"}`. Plain conversations are read as
exchanges: a turn that is not the assistant's asks (a call named by its role, its turn number as identifier), and an
assistant's turn answers the turn before it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, ship

_OPEN, _CLOSE = "<tool_call>", "</tool_call>"
_TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}
EVENT = "kind string, conv_id long, turn long, call_id string, name string, arguments string, after array<string>, content string"

#: Arguments of the calls that plain conversations are read as.
EXCHANGES = {role: {"type": "object", "properties": {"text": {"type": "string"}, "turn": {"type": "integer", "minimum": 0}}, "required": ["text", "turn"], "additionalProperties": False} for role in ("user", "system")}


def canonical(value: object) -> str:
    """JSON with sorted keys, no blanks and characters as they are; equal values give equal texts."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def violations(value: object, schema: dict, path: str = "$") -> list[str]:
    """What a value breaks of a schema's type, enum, minimum, maximum, required, properties, additionalProperties and items, in order."""
    kind, out = schema.get("type"), []
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    right = kind is None or (number and (kind == "number" or kind == "integer" and value == int(value))) or (kind in _TYPES and isinstance(value, _TYPES[kind]) and (kind != "null" or value is None))
    if not right:
        return [f"{path}: not {kind}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not in enum")
    if number and value < schema.get("minimum", value) or number and value > schema.get("maximum", value):
        out.append(f"{path}: out of range")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        out += [x for i, v in enumerate(value) for x in violations(v, schema["items"], f"{path}[{i}]")]
    return out


def _finite(x: str) -> float:
    if not math.isfinite(value := float(x)):
        raise ValueError(x)
    return value


def _refuse(x: str) -> None:
    raise ValueError(x)


def _read(text: str) -> dict:
    """The JSON object; a ValueError for anything else: NaN, infinities, numbers beyond a double, lone surrogates and too deep nesting included."""
    try:
        value = json.loads(text, parse_constant=_refuse, parse_float=_finite)
        canonical(value).encode()
    except (RecursionError, UnicodeEncodeError) as e:
        raise ValueError(text[:40]) from e
    if not isinstance(value, dict):
        raise ValueError(text[:40])
    return value


def _name(value: object) -> str:
    """An identifier or name: a string or a whole number, as text."""
    if isinstance(value, bool) or not isinstance(value, (str, int)):
        raise ValueError("not a name")
    return str(value)


def _call(body: str) -> tuple[str, str, str, list[str]]:
    call = _read(body)
    after = call.get("after")
    if after is not None and not isinstance(after, list):
        raise ValueError("after is no list")
    return _name(call.get("id")), _name(call.get("name")), canonical(call.get("arguments", {})), [_name(x) for x in after or []]


def _bodies(text: str) -> list[str]:
    """What stands between an opening tag and the next closing one, from left to right: one pass, however many tags stay open."""
    out, at = [], 0
    while (start := text.find(_OPEN, at)) >= 0 and (end := text.find(_CLOSE, start + len(_OPEN))) >= 0:
        out.append(text[start + len(_OPEN) : end])
        at = end + len(_CLOSE)
    return out


def _events(conv: int | None, turn: int | None, role: str | None, text: str | None) -> Iterator[tuple]:
    text = text or ""
    found = _bodies(text)
    for body in found:
        try:
            call_id, name, arguments, after = _call(body)
            yield "call", conv, turn, call_id, name, arguments, after, None
        except ValueError:
            yield "broken", conv, turn, None, None, body, [], None
    if role == "tool":
        try:
            result = _read(text)
            yield "result", conv, turn, _name(result.get("call_id")), None, None, [], canonical(result.get("content"))
        except ValueError:
            yield "broken", conv, turn, None, None, text, [], None
    elif role == "assistant" and not found:
        yield "result", conv, turn, None if turn is None else str(turn - 1), None, None, [], canonical(text)
    elif not found:
        before = [] if turn is None else [str(turn - 2), str(turn - 1)]
        yield "call", conv, turn, None if turn is None else str(turn), role, canonical({"text": text, "turn": turn}), before, None


def events(messages: DataFrame) -> DataFrame:
    """The calls and results in messages, and what can't be read (`broken`): no JSON object, a number that no double holds, a lone surrogate, an identifier that is neither text nor whole number, an `after` that is no list.

    Null and empty texts of plain roles are exchanges with an empty text; of the role `tool` they are broken. A null
    turn has no identifier. Repeated rows give repeated events; an empty table gives none; texts are read whole.
    """
    ship(messages.sparkSession)
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
    names = [x.split()[0] for x in EVENT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [e for m in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True) for e in _events(*m)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(run, EVENT)


def rounds(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, round) of each call with an identifier; round is null for calls on or behind a cycle.

    In order of (round, turn, call_id), every call comes after what it names in `after`. A dependency on an earlier
    turn keeps the round, one on the same or a later turn starts a new one. Calls without such late dependencies before
    them stay in round 0 and are never looked at again; the others are relaxed until nothing changes, which takes as
    many joins as the longest chain of dependencies among them. A round that exceeds the late dependencies of its
    conversation is a cycle. Dependencies on unknown calls don't count.
    """
    nodes = calls.select("conv_id", "call_id", "turn")
    edges = calls.select("conv_id", "call_id", "turn", F.explode(F.array_distinct("after")).alias("on"))
    edges = edges.join(nodes.select("conv_id", F.col("call_id").alias("on"), F.col("turn").alias("on_turn")), ["conv_id", "on"]).select("conv_id", "call_id", "on", F.coalesce(F.col("on_turn") >= F.col("turn"), F.lit(False)).cast("int").alias("late"))
    late = cut(edges.where("late = 1").groupBy("conv_id").agg(F.count("*").alias("most")), "late")
    if late.isEmpty():
        return nodes.select("conv_id", "call_id", F.lit(0).cast("long").alias("round"))
    some = cut(edges.join(late, "conv_id"), "late-edges")
    now = cut(nodes.join(late, "conv_id").select("conv_id", "call_id", "most", F.lit(0).cast("long").alias("round")), "rounds")
    while True:
        reached = some.join(now.select("conv_id", F.col("call_id").alias("on"), F.col("round").alias("r")), ["conv_id", "on"]).groupBy("conv_id", "call_id").agg(F.max(F.col("r") + F.col("late")).alias("r"))
        new = cut(now.join(reached, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "most", F.least(F.greatest("round", F.coalesce("r", "round")), F.col("most") + 1).alias("round"), (F.least(F.coalesce("r", "round"), F.col("most") + 1) > F.col("round")).alias("moved")), "rounds")
        now = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    settled = now.select("conv_id", "call_id", F.when(F.col("round") <= F.col("most"), F.col("round")).alias("round"))
    rest = nodes.join(late, "conv_id", "left_anti").select("conv_id", "call_id", F.lit(0).cast("long").alias("round"))
    return settled.union(rest)


def link(found: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Calls with their results: (conv_id, call_id, turn, round, result_turn, status, valid, errors, record).

    One row for each pair of a call and a result (`linked`), each call without one (`unanswered`), each result without
    a call (`orphan`) and each text that can't be read (`broken`). Of calls with the same identifier in a conversation
    the first by turn and arguments counts; repeats are dropped and counted in the record as `copies`. Calls of unknown
    tools are not valid. A null conv_id or identifier links to nothing. Order: round, turn, call_id.
    """
    ship(found.sparkSession)
    found = cut(found, "events")
    named = found.where("kind = 'call' and conv_id is not null and call_id is not null")
    first = named.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "arguments", "name", "after")).alias("c"), F.count("*").alias("copies"))
    calls = cut(first.select("conv_id", "call_id", "c.turn", "c.name", "c.arguments", "c.after", "copies"), "calls")
    ordered = calls.drop("after").join(rounds(calls), ["conv_id", "call_id"])
    results = found.where("kind = 'result'").select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content")
    pairs = ordered.join(results, ["conv_id", "call_id"], "left").withColumn("status", F.when(F.col("content").isNotNull(), "linked").otherwise("unanswered"))
    orphans = results.join(calls.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").withColumn("status", F.lit("orphan"))
    lost = found.where("kind = 'broken' or kind = 'call' and (conv_id is null or call_id is null)").select("conv_id", "call_id", "turn", "arguments", F.when(F.col("kind") == "call", "unanswered").otherwise("broken").alias("status"), "name")
    rows = pairs.unionByName(orphans, allowMissingColumns=True).unionByName(lost, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            valid, errors, records = [], [], []
            for r in b.to_pylist():
                wrong: list[str] = []
                if r["status"] in ("linked", "unanswered"):
                    args = json.loads(r["arguments"])
                    schema = schemas.get(r["name"])
                    wrong = violations(args, schema) if schema else [f"$: unknown tool {r['name']}"]
                    records.append(canonical({"arguments": args, "copies": r["copies"], "id": r["call_id"], "name": r["name"], "result": None if r["content"] is None else json.loads(r["content"])}))
                else:
                    wrong = [f"$: {r['status']}"]
                    records.append(canonical({"id": r["call_id"], "result": json.loads(r["content"])} if r["status"] == "orphan" else {"text": r["arguments"]}))
                valid.append(not wrong)
                errors.append("; ".join(wrong))
            column = lambda n: b.column(b.schema.get_field_index(n))
            yield pa.RecordBatch.from_arrays(
                [column("conv_id"), column("call_id"), column("turn"), column("round"), column("result_turn"), column("status"), pa.array(valid, pa.bool_()), pa.array(errors, pa.string()), pa.array(records, pa.string())],
                ["conv_id", "call_id", "turn", "round", "result_turn", "status", "valid", "errors", "record"],
            )

    rows = rows.withColumn("round", F.col("round").cast("long"))
    return rows.mapInArrow(run, "conv_id long, call_id string, turn long, round long, result_turn long, status string, valid boolean, errors string, record string")
