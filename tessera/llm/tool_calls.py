"""Chat formatting: tool-call linking.

Messages are rows (conv_id, turn, role, text). A text that is a JSON object may hold tool_calls, a list of {id, name, arguments, after}, or be the result
of one, with tool_call_id. Calls and results meet by a hash join on (conversation, identifier), not by conversation, so that a conversation with a third of
all rows is dealt like the others. Calls are placed in topological order: by turn, each after the calls it names in `after`; a call that stands before one
it needs is moved behind it, and calls in a cycle keep their places and are marked. Arguments are checked against the tool's schema and written as
canonical JSON (sorted keys, no spaces, shortest numbers, lone surrogates escaped). Arguments that no JSON parser need take (NaN, infinite numbers, nesting
beyond Python's recursion) are not JSON; a schema's type may be a list, and a type it doesn't know fits no value.

The first call with an identifier owns it, later ones are `duplicate`; the first result counts; results of no call are left out of `linked_calls` and listed
by `orphans`. Texts that aren't such JSON are plain messages. Null ids and names are values like others; null turns come first.
"""

from __future__ import annotations

import json
import math
import re
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

_MESSAGE = "tool_calls array<struct<id string, name string, arguments string, after array<string>>>, tool_call_id string, content string"
#: Steps that move calls behind those they need by joins, before `_settled` orders what is still late; turns in a range of places.
MOVES, RANGE = 20, 256
_KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def _encodable(text: str) -> str:
    """text with lone surrogates, which UTF-8 has no bytes for, as JSON escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; whole floats as integers."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 2**53 else x

    return _encodable(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _finite(text: str) -> float:
    if math.isinf(x := float(text)):
        raise ValueError(f"{text} is beyond a double")
    return x


def _refuse(text: str):
    raise ValueError(f"{text} is not JSON")


def parse(text: str | None):
    """The JSON value of a text (null: null); raises ValueError for what isn't JSON and RecursionError for what nests too deep."""
    value = json.loads(text if text is not None else "null", parse_float=_finite, parse_constant=_refuse)
    canonical(value)
    return value


def _fits(value, kind: str) -> bool:
    if kind == "integer" and isinstance(value, float):
        return value.is_integer()
    return isinstance(value, _KINDS.get(kind, ())) and not (isinstance(value, bool) and kind in ("integer", "number"))


def errors(value, schema: dict | bool, path: str = "$") -> list[str]:
    """Where value departs from a schema of type, properties, required, additionalProperties, items and enum. A schema that is true or no object allows all, false nothing."""
    if schema is False:
        return [f"{path}: not allowed"]
    if not isinstance(schema, dict):
        return []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    if kinds and not any(_fits(value, k) for k in kinds):
        return [f"{path}: not of type {' or '.join(map(str, kinds))}"]
    found = [f"{path}: not among the allowed values"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        own = schema.get("properties", {})
        found += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        found += [e for k in sorted(value) if k in own for e in errors(value[k], own[k], f"{path}.{k}")]
        if schema.get("additionalProperties") is False:
            found += [f"{path}.{k}: not in the schema" for k in sorted(value) if k not in own]
    if isinstance(value, list) and "items" in schema:
        found += [e for i, x in enumerate(value) for e in errors(x, schema["items"], f"{path}[{i}]")]
    return found


def _ids(name: str) -> list:
    return [F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"), F.coalesce(F.col(name), F.lit("")).alias("k")]


def _parsed(messages: DataFrame) -> DataFrame:
    body = F.when(F.ltrim("text").startswith("{"), F.from_json("text", _MESSAGE))
    return messages.select("conv_id", F.coalesce(F.col("turn").cast("bigint"), F.lit(-1)).alias("turn"), "text", body.alias("m"))


def _results(parsed: DataFrame) -> DataFrame:
    rows = parsed.where(F.col("m.tool_call_id").isNotNull()).select("conv_id", "turn", F.col("m.tool_call_id").alias("id"), F.col("m.content").alias("content"))
    return rows.groupBy(*_ids("id")).agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))


def settle(own: list[tuple[int, int]], needs: list[list[int]]) -> list[tuple[int, int, bool]]:
    """(place, depth, cycle) of calls with (turn, i) own, which need the calls at the positions `needs`: Tarjan's components, each after those it needs.
    Members of a cycle keep their places; a call behind one is placed behind it like behind any other."""
    n, count, stack, key = len(own), 0, [], [None] * len(own)
    seen, low, on, cyclic = [-1] * n, [0] * n, [False] * n, [False] * n
    for start in range(n):
        work = [(start, iter(needs[start]))] if seen[start] < 0 else []
        while work:
            v, todo = work[-1]
            if seen[v] < 0:
                seen[v] = low[v] = count
                count += 1
                stack.append(v)
                on[v] = True
            for w in todo:
                if seen[w] < 0:
                    work.append((w, iter(needs[w])))
                    break
                if on[w]:
                    low[v] = min(low[v], seen[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] < seen[v]:
                    continue
                at = len(stack) - 1
                while stack[at] != v:
                    at -= 1
                members = stack[at:]
                del stack[at:]
                for m in members:
                    on[m], (turn, i) = False, own[m]
                    key[m] = (turn, 0, turn, i)
                    cyclic[m] = len(members) > 1 or m in needs[m]
                    if needs[m] and not cyclic[m] and (need := max(key[w] for w in needs[m])) >= key[m]:
                        key[m] = (need[0], need[1] + 1, turn, i)
    return [(k[0], k[1], c) for k, c in zip(key, cyclic, strict=True)]


def _settled(calls: DataFrame, ends: DataFrame, late: DataFrame) -> DataFrame:
    """(c, k, place, depth, cycle) of the calls that hang together, over needs, with a late one; each such group is ordered in one task."""
    node = lambda k: F.xxhash64("c", k)
    hot = late.select("c").distinct()
    edges = common.materialize(ends.where("known").join(hot, "c", "left_semi").select("c", "to", F.col("k").alias("need")))
    linked = common.materialize(common.components(edges.select(node("need").alias("u"), node("to").alias("v"))))
    part = F.coalesce("root", node("k"))
    of = lambda df: df.join(linked, node("k") == F.col("node"), "left").withColumn("part", part).drop("node", "root")
    needs = edges.groupBy("c", F.col("to").alias("k")).agg(F.collect_list("need").alias("needs"))
    rows = of(calls.select("c", "k", "turn", "i").join(hot, "c", "left_semi")).join(of(late.select("c", "k")).select("part").distinct(), "part", "left_semi")
    rows = rows.join(needs, ["c", "k"], "left").select("part", "c", "k", "turn", "i", "needs").repartition("part").sortWithinPartitions("part")

    def run(batches):
        flat = (row for batch in batches for row in zip(*(x.to_pylist() for x in batch.columns), strict=True))
        for _, group in groupby(flat, lambda row: row[0]):  # a group may go on in the next batch
            _, c, k, turn, i, needed = zip(*group, strict=True)
            at = {x: n for n, x in enumerate(zip(c, k, strict=True))}
            found = settle(list(zip(turn, i, strict=True)), [[at[x, y] for y in ys or ()] for x, ys in zip(c, needed, strict=True)])
            place, depth, cycle = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(k), pa.array(place, pa.int64()), pa.array(depth, pa.int32()), pa.array(cycle)], names=["c", "k", "place", "depth", "cycle"])

    return rows.mapInArrow(run, "c string, k string, place bigint, depth int, cycle boolean")


def _moved(calls: DataFrame) -> DataFrame:
    """calls: (c, k, turn, i, after). (c, k, place, depth, missing, cycle): the order is by place, depth, turn, i."""
    edges = calls.select("c", F.col("k").alias("to"), F.explode("after").alias("k")).where("k is not null").distinct()
    ends = common.materialize(edges.join(calls.select("c", "k", F.lit(True).alias("known")), ["c", "k"], "left").select("c", "k", "to", F.coalesce("known", F.lit(False)).alias("known")))
    lacking = ends.where(~F.col("known")).groupBy("c", F.col("to").alias("k")).agg(F.count(F.lit(1)).alias("missing"))
    at = common.materialize(calls.select("c", "k", "turn", "i", F.col("turn").alias("place"), F.lit(0).alias("depth")))
    key = F.struct("place", "depth", "turn", "i")
    late = None
    for step in range(MOVES + 1):
        needed = ends.where("known").join(at.select("c", "k", key.alias("need")), ["c", "k"]).select("c", F.col("to").alias("k"), "need")
        late = needed.join(at.select("c", "k", key.alias("own")), ["c", "k"]).where("need >= own").groupBy("c", "k").agg(F.max("need").alias("need"))
        late = common.materialize(late)
        if step == MOVES or late.isEmpty():
            break
        at = at.join(late, ["c", "k"], "left")
        at = common.materialize(at.select("c", "k", "turn", "i", F.coalesce("need.place", "place").alias("place"), F.coalesce(F.col("need.depth") + 1, F.col("depth")).alias("depth")))
    at = at.select("c", "k", "place", "depth", F.lit(False).alias("cycle"))
    if not late.isEmpty():
        new = common.materialize(_settled(calls, ends, late))
        at = at.join(new, ["c", "k"], "left_anti").unionByName(new)
    at = at.join(lacking, ["c", "k"], "left")
    return at.select("c", "k", "place", "depth", F.coalesce("missing", F.lit(0).cast("bigint")).alias("missing"), "cycle")


def linked_calls(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """A row for each tool call: (conv_id, turn, call_id, name, position, result_turn, n_results, status, arguments, problems, json). position counts from 0
    in the conversation; json is the canonical form of the call with its result."""
    parsed = _parsed(messages)
    each = parsed.where(F.size("m.tool_calls") > 0).select("conv_id", "turn", F.posexplode("m.tool_calls").alias("i", "x")).where("x is not null")
    each = each.select("conv_id", "turn", "i", F.col("x.id").alias("id"), F.col("x.name").alias("name"), F.col("x.arguments").alias("arguments"), F.coalesce("x.after", F.array().cast("array<string>")).alias("after"))
    each = common.materialize(each.select("*", *_ids("id")))
    owners = each.groupBy("c", "k").agg(F.min(F.struct("turn", "i", "name", "arguments", "id", "after")).alias("o"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    owners = common.materialize(owners.select("c", "k", "conv_id", "o.*", "n"))
    order = _moved(owners.select("c", "k", "turn", "i", "after"))
    joined = owners.join(order, ["c", "k"]).join(_results(parsed).hint("shuffle_hash"), ["c", "k"], "left")
    # Places in a conversation: counts of ranges of turns, summed, and a window inside a range, so that no conversation is one task.
    joined = joined.withColumn("g", F.floor(F.col("place") / RANGE))
    ranges = joined.groupBy("c", "g").agg(F.count(F.lit(1)).alias("m"))
    ranges = ranges.select("c", "g", F.coalesce(F.sum("m").over(Window.partitionBy("c").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("c", "g").orderBy("place", "depth", "turn", "i", "k"))
    placed = joined.join(ranges, ["c", "g"]).withColumn("position", (F.col("base") + inside - 1).cast("bigint"))
    plain = placed.select("conv_id", "turn", F.col("id").alias("call_id"), "name", "position", F.col("r.turn").alias("result_turn"), F.coalesce("n_results", F.lit(0).cast("bigint")).alias("n_results"), (F.col("n") - 1).alias("n_duplicates"), "missing", "cycle", "arguments", F.col("r.content").alias("content"))
    kind = messages.schema["conv_id"].dataType.simpleString()
    names = "turn bigint, call_id string, name string, position bigint, result_turn bigint, n_results bigint, n_duplicates bigint, status string, problems array<string>, json string"

    def run(batches):
        for batch in batches:
            status, problems, texts = [], [], []
            for _, turn, call_id, name, position, result_turn, n, copies, missing, cycle, arguments, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    value = parse(arguments)
                    bad = errors(value, schemas[name]) if name in schemas else [f"no schema for {name}"]
                except (ValueError, RecursionError):
                    value, bad = arguments, ["arguments are not JSON"]
                bad += ["duplicate identifier"] * bool(copies) + ["a call that it needs is missing"] * bool(missing) + ["cycle"] * bool(cycle)
                status.append("invalid" if bad else "linked" if n else "pending")
                problems.append([_encodable(x) for x in bad])
                texts.append(canonical({"id": call_id, "name": name, "arguments": value, "result": content}))
            own = [batch.column(i) for i in range(8)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(status), pa.array(problems, pa.list_(pa.string())), pa.array(texts, pa.string())], names=[*batch.schema.names[:8], "status", "problems", "json"])

    return plain.mapInArrow(run, f"conv_id {kind}, {names}")


def orphans(messages: DataFrame) -> DataFrame:
    """(conv, call_id, turn) of the results that no call asked for."""
    parsed = _parsed(messages)
    calls = parsed.select("conv_id", F.explode("m.tool_calls").alias("x")).select("conv_id", F.col("x.id").alias("id")).select(*_ids("id")).distinct()
    return _results(parsed).join(calls, ["c", "k"], "left_anti").select(F.col("c").alias("conv"), F.col("k").alias("call_id"), "r.turn")


def as_calls(conversations: DataFrame) -> DataFrame:
    """The driver's conversations hold plain turns only; here every assistant turn is a call `reply`, which needs the reply before it, and the turn after it is its result."""
    turn = F.col("turn")
    name = lambda t: F.concat(F.lit("call-"), t.cast("string"))
    arguments = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.size(F.split(F.coalesce("text", F.lit("")), " ")).alias("words")))
    call = F.struct(name(turn).alias("id"), F.lit("reply").alias("name"), arguments.alias("arguments"), F.when(turn >= 3, F.array(name(turn - 2))).otherwise(F.array().cast("array<string>")).alias("after"))
    text = F.when(F.col("role") == "assistant", F.to_json(F.struct(F.array(call).alias("tool_calls"))))
    text = text.otherwise(F.to_json(F.struct(name(turn - 1).alias("tool_call_id"), F.col("text").alias("content"))))
    return conversations.select("conv_id", "turn", "role", text.alias("text"))


REPLY = {"reply": {"type": "object", "properties": {"text": {"type": "string"}, "words": {"type": "integer"}}, "required": ["text", "words"], "additionalProperties": False}}


def op2_tool_calls(spark, sf_dir: str) -> DataFrame:
    return linked_calls(as_calls(common.read(spark, sf_dir, "conversations")), REPLY)
