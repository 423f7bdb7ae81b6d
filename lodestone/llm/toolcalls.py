"""Chat formatting: links tool calls with their results, orders and validates them, and writes canonical JSON.

Calls and results meet in a hash join on (conversation, identifier), so a conversation of any length is spread over all
tasks. Each call gets a place in a topological order of its dependencies: rows sorted by (wave, turn, place) have every
call after those it depends on. `wave` counts the dependencies that point forward in the conversation on the way to a
call; where all point back, as they should, it is 0 and nothing is iterated. Conversations with a forward dependency are
settled by rounds of pointer doubling; what never resolves is a cycle.

Statuses, the first that applies: no_id, duplicate (a later call with an identifier already taken), unknown_tool,
invalid_arguments (not JSON, or against the tool's schema), cycle, missing_dependency, no_result, ok. Of several results
the first by turn is linked. Results without a call are returned by `orphans`.

Null texts and texts that are not JSON objects hold no calls; very long and deeply nested ones are read whole, as far as
JSON's parser goes, and what it refuses (also numbers out of range) is no JSON. Lone surrogates are kept as escapes. Calls
of equal identifiers are ranked by turn, place, name and arguments, so ties are repeated rows. Nulls in arguments count as invalid JSON. Repeated rows
are duplicates. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.tables import Workspace

CALL = "conv_id {kind}, turn long, place int, call_id string, name string, arguments string, depends_on array<string>"
RESULT = "conv_id {kind}, turn long, call_id string, content string"
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


_LONE = re.compile("[\ud800-\udfff]")


class _Raw(str):
    """A piece of finished JSON."""


def _safe(text: str) -> str:
    """The text with each lone surrogate, which UTF-8 cannot hold, as its escape."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: object) -> str:
    """JSON with sorted keys and no spare space; whole floats are written as integers, as equal numbers must be.

    Any value that `parsed` returns has a text: nesting of any depth (there is no recursion), numbers of any length, and lone
    surrogates, which stay escaped.
    """
    out: list[str] = []
    stack: list[object] = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, _Raw):
            out.append(x)
        elif isinstance(x, dict):
            pieces: list[object] = [_Raw("{")]
            for i, k in enumerate(sorted(x)):
                pieces += [_Raw(("," if i else "") + json.dumps(k, ensure_ascii=False) + ":"), x[k]]
            stack += [*pieces, _Raw("}")][::-1]
        elif isinstance(x, list):
            pieces = [_Raw("[")]
            for i, v in enumerate(x):
                pieces += [_Raw(","), v] if i else [v]
            stack += [*pieces, _Raw("]")][::-1]
        elif isinstance(x, float) and x.is_integer() and abs(x) < 2**53:
            out.append(str(int(x)))
        else:
            out.append(json.dumps(x, ensure_ascii=False, allow_nan=False))
    return _safe("".join(out))


def _finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(f"{text[:40]} is out of range")
    return value


def parsed(text: str | None) -> object:
    """The JSON value of a text, or the ValueError that says why it has none.

    Numbers beyond the range of doubles, integers of more than 4300 digits and nesting beyond the parser's own limit (some
    thousands) are no JSON here.
    """
    try:
        return json.loads(text, parse_float=_finite, parse_constant=_finite)
    except (ValueError, TypeError, RecursionError) as e:
        return ValueError(str(e))


def violations(value: object, schema: dict, path: str = "$") -> list[str]:
    """What a value breaks of a schema: type, enum, required, properties, additionalProperties, items and limits."""
    out: list[str] = []
    kind = schema.get("type")
    if kind is not None:
        kinds = kind if isinstance(kind, list) else [kind]
        if not any(_is(value, k) for k in kinds):
            return [f"{path}: not {'|'.join(kinds)}"]
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{path}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}: lacks {k}" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{path}: has {k}" for k in sorted(value) if k not in known]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{path}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{path}[{i}]")
    if isinstance(value, str):
        out += [f"{path}: {what}" for what, bad in (("short", len(value) < schema.get("minLength", 0)), ("long", len(value) > schema.get("maxLength", len(value)))) if bad]
    if _is(value, "number"):
        out += [f"{path}: {what}" for what, bad in (("low", value < schema.get("minimum", value)), ("high", value > schema.get("maximum", value))) if bad]
    return out


def _is(value: object, kind: str) -> bool:
    if kind in ("number", "integer"):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return number and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, TYPES[kind])


def parse(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of messages (conv_id, turn, role, text) whose texts are JSON objects.

    An assistant message holds {"tool_calls": [{"id", "name", "arguments", "depends_on"}, ...]}, a tool message
    {"tool_call_id", "content"}. Arguments may be an object or a string of JSON.
    """

    def calls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], [], [], [], [], [], []]
            for i, text in enumerate(b.column(2).to_pylist()):
                value = parsed(text)
                found = value.get("tool_calls") if isinstance(value, dict) else None
                for k, c in enumerate(found if isinstance(found, list) else []):
                    c = c if isinstance(c, dict) else {}
                    given, needs = c.get("arguments"), c.get("depends_on")
                    row = (b.column(0)[i].as_py(), b.column(1)[i].as_py(), k, _text(c.get("id")), _text(c.get("name")), _text(given), [_text(x) or "null" for x in needs] if isinstance(needs, list) else [])
                    for column, v in zip(rows, row, strict=True):
                        column.append(v)
            kinds = [b.schema.field(0).type, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds, strict=True)], ["conv_id", "turn", "place", "call_id", "name", "arguments", "depends_on"])

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, text in enumerate(b.column(2).to_pylist()):
                value = parsed(text)
                if isinstance(value, dict) and "tool_call_id" in value:
                    content = value.get("content")
                    rows.append((b.column(0)[i].as_py(), b.column(1)[i].as_py(), _text(value["tool_call_id"]), _text(content)))
            kinds = [b.schema.field(0).type, pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 4, kinds, strict=True)], ["conv_id", "turn", "call_id", "content"])

    kind = messages.schema["conv_id"].dataType.simpleString()
    of = lambda role: messages.where(F.col("role") == role).select("conv_id", F.col("turn").cast("long").alias("turn"), "text")
    return of("assistant").mapInArrow(calls, CALL.format(kind=kind)), of("tool").mapInArrow(results, RESULT.format(kind=kind))


def _text(value: object) -> str | None:
    return None if value is None else _safe(value) if isinstance(value, str) else canonical(value)


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conv_id, turn, place, call_id, name, wave, status, result_turn, json (canonical; null for broken arguments)."""
    space = Workspace(calls.sparkSession, "toolcalls")
    with_id = "conv_id IS NOT NULL AND call_id IS NOT NULL"
    named = calls.where(with_id)
    # A key's rows are the calls that claim one identifier, not a conversation.
    rank = F.row_number().over(Window.partitionBy("conv_id", "call_id").orderBy("turn", "place", "name", "arguments"))
    named = named.withColumn("again", rank > 1)
    first = results.where(with_id).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"))
    linked = named.join(first, ["conv_id", "call_id"], "left")
    linked = linked.unionByName(calls.where(f"NOT ({with_id})").withColumn("again", F.lit(False)), allowMissingColumns=True)
    linked = space.write(linked.select("conv_id", "turn", "place", "call_id", "name", "arguments", "depends_on", "again", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content")), "linked")

    heads = linked.where(f"{with_id} AND NOT again").select("conv_id", "call_id", "turn", "place")
    needs = linked.where(f"{with_id} AND NOT again AND size(depends_on) > 0").select("conv_id", "call_id", "turn", "place", F.explode(F.array_distinct("depends_on")).alias("needed"))
    ends = heads.select("conv_id", F.col("call_id").alias("needed"), F.struct("turn", "place").alias("at"))
    edges = needs.join(ends, ["conv_id", "needed"], "left").withColumn("forward", F.col("at") >= F.struct("turn", "place"))
    edges = space.write(edges.select("conv_id", "call_id", "needed", F.col("at").isNull().alias("missing"), F.coalesce("forward", F.lit(False)).alias("forward")), "edges")
    lost = edges.where("missing").select("conv_id", "call_id").distinct().withColumn("lost", F.lit(True))
    waves = _waves(heads, edges.where("NOT missing"), space)

    ready = linked.join(lost, ["conv_id", "call_id"], "left").join(waves, ["conv_id", "call_id"], "left")
    ready = ready.select("conv_id", "turn", "place", "call_id", "name", F.when(F.col("wave") != -1, F.col("wave")).otherwise(F.when(F.col("wave").isNull(), 0)).alias("wave"), "result_turn", "arguments", "depends_on", "content", "again", F.coalesce("lost", F.lit(False)).alias("lost"), (F.coalesce("wave", F.lit(0)) == -1).alias("cycle"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            statuses, texts = [], []
            for conv, call, name, result_turn, arguments, needs, content, again, lost, cycle in zip(*(b.column(k).to_pylist() for k in (0, 3, 4, 6, 7, 8, 9, 10, 11, 12)), strict=True):
                value = parsed(arguments)
                broken = isinstance(value, ValueError)
                checks = (
                    ("no_id", conv is None or call is None),
                    ("duplicate", again),
                    ("unknown_tool", name not in schemas),
                    ("invalid_arguments", broken or (name in schemas and bool(violations(value, schemas[name])))),
                    ("cycle", cycle),
                    ("missing_dependency", lost),
                    ("no_result", result_turn is None),
                    ("ok", True),
                )
                statuses.append(next(s for s, holds in checks if holds))
                texts.append(None if broken else canonical({"arguments": value, "call_id": call, "depends_on": sorted(set(needs or [])), "name": name, "result": content}))
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(statuses, pa.string()), b.column(6), pa.array(texts, pa.string())], [*b.schema.names[:6], "status", "result_turn", "json"])

    kind = calls.schema["conv_id"].dataType.simpleString()
    return ready.mapInArrow(write, f"conv_id {kind}, turn long, place int, call_id string, name string, wave int, status string, result_turn long, json string")


def _waves(heads: DataFrame, edges: DataFrame, space: Workspace) -> DataFrame:
    """(conv_id, call_id, wave) of the calls in conversations with a forward dependency; wave -1 for cycles.

    A round resolves calls whose dependencies are all resolved, and lets every other dependency on a call that itself
    waits for one call only jump over it (pointer doubling): wave = max(low, wave of that one + weight). So a chain takes as
    many rounds as its length has binary digits, and a graph about that many for each level at which it branches.
    """
    key = ["conv_id", "call_id"]
    hit = edges.where("forward").select("conv_id").distinct()
    waits = edges.join(hit, "conv_id", "left_semi").select(*key, "needed", F.col("forward").cast("long").alias("weight"))
    waits = space.write(waits, "open")
    left = space.write(heads.join(hit, "conv_id", "left_semi").select(*key, F.lit(0).cast("long").alias("low")), "left")
    done = []
    while not left.isEmpty():
        ready = left.join(waits.select(key).distinct(), key, "left_anti").select(*key, F.col("low").alias("wave"))
        ready = space.write(ready, "resolved")
        if ready.isEmpty():
            break
        done.append(ready)
        known = ready.select("conv_id", F.col("call_id").alias("needed"), "wave")
        told = waits.join(known, ["conv_id", "needed"], "left")
        still = told.where("wave IS NULL").drop("wave")
        single = still.groupBy(key).agg(F.count("*").alias("n"), F.min("needed").alias("over"), F.min("weight").alias("further")).where("n = 1")
        lows = told.where("wave IS NOT NULL").select(*key, (F.col("wave") + F.col("weight")).alias("up"))
        left = left.join(ready, key, "left_anti")
        lows = left.unionByName(lows.select(*key, F.col("up").alias("low"))).groupBy(key).agg(F.max("low").alias("low"))
        lows = space.write(lows, "lows")
        jumps = single.join(lows, key).select("conv_id", F.col("call_id").alias("needed"), "over", "further", F.col("low").alias("least"))
        moved = still.join(jumps, ["conv_id", "needed"], "left").withColumn("jumps", F.coalesce(F.col("over") != F.col("call_id"), F.lit(False)))
        # Only in a cycle do weights grow without end; there they mean nothing.
        weight = F.when(F.col("jumps"), F.least(F.col("weight") + F.col("further"), F.lit(1 << 40))).otherwise(F.col("weight"))
        moved = space.write(moved.select(*key, F.when(F.col("jumps"), F.col("over")).otherwise(F.col("needed")).alias("needed"), weight.alias("next"), F.when(F.col("jumps"), F.least(F.col("least") + F.col("weight"), F.lit(1 << 40))).alias("low")), "moved")
        left = space.write(lows.unionByName(moved.where("low IS NOT NULL").select(*key, "low")).groupBy(key).agg(F.max("low").alias("low")), "left")
        waits = space.write(moved.groupBy(*key, "needed").agg(F.max("next").alias("weight")), "open")
    out = left.select(*key, F.lit(-1).cast("long").alias("wave"))
    for part in done:
        out = out.unionByName(part)
    return out.withColumn("wave", F.col("wave").cast("int"))


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose identifier no call of their conversation has."""
    known = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL").select("conv_id", "call_id").distinct()
    return results.join(known, ["conv_id", "call_id"], "left_anti")


#: Plain conversations as calls: a user turn asks for a reply, which the next turn gives.
REPLY = {"reply": {"type": "object", "required": ["prompt"], "properties": {"prompt": {"type": "string", "minLength": 1}}, "additionalProperties": False}}


def as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of conversations without tools (conv_id, turn, role, text).

    A user turn calls `reply` with its text, under the identifier "conversation-turn", and depends on the user turn two
    turns before, where there is one. An assistant turn answers the turn before it.
    """
    name = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    users = turns.where("role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL")
    before = users.select("conv_id", (F.col("turn") + 2).alias("turn")).distinct().withColumn("follows", F.lit(True))
    asked = users.join(before, ["conv_id", "turn"], "left")
    prompt = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prompt")))
    needs = F.when(F.col("follows"), F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    calls = asked.select("conv_id", F.col("turn").cast("long").alias("turn"), F.lit(0).alias("place"), name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), prompt.alias("arguments"), needs.alias("depends_on"))
    replies = turns.where("role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL")
    return calls, replies.select("conv_id", F.col("turn").cast("long").alias("turn"), name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
