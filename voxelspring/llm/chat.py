"""Chat formatting: tool calls linked to their results, ordered, validated and serialised.

Calls and results are two tables. A result is linked to the call with its identifier by a hash join;
calls name the calls they depend on: a call is ready once all it depends on are ordered, and its level
is the longest way there. Conversations are ordered whole, a row for each, up to GROUP calls and
dependencies; longer ones in blocks of as many calls, in rounds between the blocks. Arguments are validated against the
tool's schema, and each call with its result becomes one line of canonical JSON (sorted keys, no
spare white space, RFC 8259 escapes).

`calls_and_results` reads both tables from chat messages. A message whose text is a JSON object with
"tool_calls" makes its calls, one with "tool_call_id" is a result. A call has its name and arguments
itself, or in "function", where the arguments may be JSON text. In plain chat every message that
is not the assistant's is a call of the tool "reply" that depends on the conversation's opening
message, and an assistant's message is the result of the message before it.

Defined results: rows with a null conversation or turn take no part; a null text is the empty text;
of calls that share an identifier the first counts, and so for results (by turn, then place, then
text); a result without a call, and a call without a result, are reported as such; a call that
depends on itself in a circle, or on such a call, has no level; one that depends on an unknown call
waits for nothing and has an error; a call without an identifier gets its turn and place as one, a
result without one its turn, and a call an error; numbers that JSON can't write (NaN, infinities, too many digits) are
read as null, halves of surrogate pairs as U+FFFD, and a call with such numbers has an error; text that
is no JSON, or nested deeper than DEEPEST, is plain chat; an empty table gives no rows; further
columns don't matter.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspring.cloud import with_pid
from voxelspring.llm.common import drop_stored, stored, table

#: JSON-Schema subset: type, required, properties, additionalProperties, enum, bounds.
SCHEMAS = {
    "reply": {
        "type": "object",
        "required": ["role", "text", "turn"],
        "additionalProperties": False,
        "properties": {"role": {"type": "string", "enum": ["system", "user"]}, "text": {"type": "string", "minLength": 1, "maxLength": 100_000}, "turn": {"type": "integer", "minimum": 0}},
    }
}
#: Calls and dependencies of a conversation that is ordered as one row.
GROUP = 20_000
#: Nested arrays and objects of a message that is read as JSON.
DEEPEST = 100
LONE = re.compile("[\ud800-\udfff]")
STRING_OR_BRACKET = re.compile(r'"(?:[^"\\]|\\.)*"|[\[{]|[\]}]', re.S)
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "number": (int, float), "integer": int}


def canonical(value) -> str:
    return LONE.sub("\ufffd", json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def too_deep(text: str) -> bool:
    if text.count("[") + text.count("{") <= DEEPEST:
        return False
    depth = most = 0
    for m in STRING_OR_BRACKET.finditer(text):
        depth += {"[": 1, "{": 1, "]": -1, "}": -1}.get(m[0], 0)
        most = max(most, depth)
    return most > DEEPEST


def read_json(text: str) -> tuple[object, list[str]]:
    """The value, and what of it JSON can't write and is null instead. Raises ValueError."""
    notes: list[str] = []

    def number(kind, digits: str):
        value = kind(digits) if len(digits) <= 300 else math.inf
        if not math.isfinite(value):
            notes.append("number out of range")
            return None
        return value

    if too_deep(text):
        raise ValueError("nested too deeply")
    found = json.loads(text, parse_int=lambda t: number(int, t), parse_float=lambda t: number(float, t), parse_constant=lambda t: notes.append(f"{t} is no number"))
    return found, sorted(set(notes))


def name_of(value) -> str:
    return LONE.sub("\ufffd", value) if isinstance(value, str) else canonical(value)


def read_call(call: dict, turn: int, place: int) -> tuple[str, str, str, list[str], list[str]]:
    """Identifier, tool, arguments as canonical JSON, what it depends on, and what is wrong with it."""
    notes: list[str] = []
    own = call["function"] if isinstance(call.get("function"), dict) else call
    arguments = own.get("arguments")
    if own is not call and isinstance(arguments, str):
        try:
            arguments, notes = read_json(arguments)
        except ValueError:
            notes = ["arguments are no JSON"]
    if call.get("id") is None:
        notes.append("no identifier")
    if own.get("name") is None:
        notes.append("no tool name")
    needs = call.get("depends_on")
    return (
        f"{turn}.{place}" if call.get("id") is None else name_of(call["id"]),
        "" if own.get("name") is None else name_of(own["name"]),
        canonical(arguments),
        [name_of(n) for n in needs] if isinstance(needs, list) else [],
        notes,
    )


def faults(value, schema: dict, where: str = "$") -> list[str]:
    """Why a value doesn't fit a schema; empty if it does."""
    kinds = schema.get("type") or []
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(value is None if k == "null" else isinstance(value, TYPES[k]) and (k == "boolean" or not isinstance(value, bool)) for k in kinds):
        return [f"{where}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{where}: not in enum")
    if isinstance(value, str):
        out += [f"{where}: shorter than {schema['minLength']}"] if len(value) < schema.get("minLength", 0) else []
        out += [f"{where}: longer than {schema['maxLength']}"] if "maxLength" in schema and len(value) > schema["maxLength"] else []
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{where}: below {schema['minimum']}"] if "minimum" in schema and value < schema["minimum"] else []
        out += [f"{where}: above {schema['maximum']}"] if "maximum" in schema and value > schema["maximum"] else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{where}.{k}: missing" for k in sorted(schema.get("required", ())) if k not in value]
        for k in sorted(value):
            if k in known:
                out += faults(value[k], known[k], f"{where}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{where}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += faults(v, schema["items"], f"{where}[{i}]")
    return out


CALLS = "conv_id long, turn long, place int, call_id string, tool string, arguments string, depends_on array<string>, notes array<string>"
RESULTS = "conv_id long, turn long, place int, call_id string, content string"


def calls_and_results(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    own = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv_id IS NOT NULL AND turn IS NOT NULL")
    opening = own.groupBy("conv_id").agg(F.min("turn").alias("opening"))
    own = own.join(opening, "conv_id")

    def parsed(text: str) -> tuple[str | None, dict, list[str]]:
        """Which kind of message it is, the object, and its notes."""
        if text.startswith("{") and ('"tool_calls"' in text or '"tool_call_id"' in text):
            try:
                value, notes = read_json(text)
            except (ValueError, RecursionError):
                return None, {}, []
            kind = next((k for k in ("tool_calls", "tool_call_id") if isinstance(value, dict) and k in value), None)
            return kind, value, notes
        return None, {}, []

    def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    first = [("conv_id", pa.int64()), ("turn", pa.int64()), ("place", pa.int32()), ("call_id", pa.string())]
    call_schema = pa.schema([*first, ("tool", pa.string()), ("arguments", pa.string()), ("depends_on", pa.list_(pa.string())), ("notes", pa.list_(pa.string()))])
    result_schema = pa.schema([*first, ("content", pa.string())])

    def called(batches):
        for batch in batches:
            rows = []
            for conv, turn, role, text, opening in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "opening")), strict=True):
                kind, made, notes = parsed(text)
                if kind == "tool_calls":
                    calls = made["tool_calls"] if isinstance(made["tool_calls"], list) else []
                    for place, call in enumerate(calls):
                        if isinstance(call, dict):
                            *fields, own_notes = read_call(call, turn, place)
                            rows.append((conv, turn, place, *fields, sorted({*notes, *own_notes})))
                elif kind is None and role != "assistant":
                    rows.append((conv, turn, 0, str(turn), "reply", canonical({"role": role, "text": text, "turn": turn}), [str(opening)] if turn > opening else [], []))
            yield batch_of(rows, call_schema)

    def resulted(batches):
        for batch in batches:
            rows = []
            for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                kind, made, _ = parsed(text)
                if kind == "tool_call_id":
                    rows.append((conv, turn, 0, str(turn) if made[kind] is None else name_of(made[kind]), canonical(made.get("content"))))
                elif kind is None and role == "assistant":
                    rows.append((conv, turn, 0, str(turn - 1), canonical(text)))
            yield batch_of(rows, result_schema)

    return own.mapInArrow(called, CALLS), own.mapInArrow(resulted, RESULTS)


def first_of(rows: DataFrame, *values: str) -> DataFrame:
    """Of rows that share an identifier, the first by turn, place and values, with their number."""
    first = F.min(F.struct("turn", "place", *values)).alias("first")
    return rows.groupBy("conv_id", "call_id").agg(first, F.count(F.lit(1)).cast("long").alias("copies")).select("conv_id", "call_id", "first.*", "copies")


def order_of(ids: list[str], needs: list[list[str]]) -> tuple[list[int | None], list[int]]:
    """Level of each call of a conversation, null in circles, and how many of its dependencies name no call."""
    at = {c: i for i, c in enumerate(ids)}
    known = [{at[n] for n in own if n in at} for own in needs]
    unknown = [len({n for n in own if n not in at}) for own in needs]
    waiting, after = [len(k) for k in known], [[] for _ in ids]
    for i, own in enumerate(known):
        for j in own:
            after[j].append(i)
    level: list[int | None] = [None] * len(ids)
    ready, now = [i for i, n in enumerate(waiting) if not n], 0
    while ready:
        freed = []
        for i in ready:
            level[i] = now
            for j in after[i]:
                waiting[j] -= 1
                if not waiting[j]:
                    freed.append(j)
        ready, now = freed, now + 1
    return level, unknown


def levels(calls: DataFrame, group: int = GROUP) -> DataFrame:
    """conv_id, call_id, level, unknown (dependencies that name no call); level is null in circles."""
    own = calls.select("conv_id", *[c for c in ("turn", "place") if c in calls.columns], "call_id", "depends_on")
    sizes = own.groupBy("conv_id").agg(F.sum(1 + F.size("depends_on")).alias("size"))
    long = stored(sizes.where(F.col("size") > group).select("conv_id"))
    whole = own.join(long, "conv_id", "left_anti").groupBy("conv_id").agg(F.collect_list("call_id").alias("ids"), F.collect_list("depends_on").alias("needs"))

    def ordered(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for conv, ids, needs in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "needs")), strict=True):
                for to, values in zip(out, ([conv] * len(ids), ids, *order_of(ids, needs)), strict=True):
                    to.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["conv_id", "call_id", "level", "unknown"])

    found = whole.mapInArrow(ordered, "conv_id long, call_id string, level long, unknown long")
    if not long.limit(1).count():
        return found
    return found.union(levels_by_rounds(own.join(long, "conv_id", "left_semi"), group))


def levels_by_rounds(calls: DataFrame, group: int = GROUP) -> DataFrame:
    """The same for conversations of any length. Their calls are numbered in the order of turns and cut into
    blocks of `group`. In a round each block orders all that it can with the levels that others have found,
    however long its own chains are; so there are as many rounds as the longest way goes from block to block,
    one or two where calls depend on earlier ones close by."""
    order = [c for c in ("turn", "place") if c in calls.columns]
    own = with_pid(calls.select("conv_id", *order, "call_id", "depends_on"), "conv_id", *order, "call_id", name="number", count=False)
    own = stored(own.select("conv_id", "call_id", "depends_on", "number", F.floor(F.col("number") / group).alias("block")))
    named = own.select("conv_id", "number", "block", F.explode(F.array_distinct("depends_on")).alias("needs"))
    at = own.select("conv_id", F.col("call_id").alias("needs"), F.col("number").alias("dep"), F.col("block").alias("dep_block"))
    edges = stored(named.join(at, ["conv_id", "needs"], "left").select("number", "block", "dep", "dep_block"))
    unknown = edges.where("dep IS NULL").groupBy("number").agg(F.count(F.lit(1)).alias("unknown"))
    needs = edges.where("dep IS NOT NULL").groupBy("number").agg(F.collect_list("dep").alias("deps"))
    nodes = stored(own.select("block", "number").join(needs, "number", "left"))
    outside = stored(edges.where("block <> dep_block").select("block", "dep").distinct())

    def ordered(mine: pa.Table, given: pa.Table) -> pa.Table:
        ids, deps = mine.column("number").to_pylist(), mine.column("deps").to_pylist()
        level = dict(zip(given.column("dep").to_pylist(), given.column("level").to_pylist(), strict=True))
        after: dict[int, list[int]] = {}
        waiting, most = {}, {}
        for i, own in zip(ids, deps, strict=True):
            open_ = [d for d in own or [] if d not in level]
            waiting[i], most[i] = len(open_), max((level[d] + 1 for d in own or [] if d in level), default=0)
            for d in open_:
                after.setdefault(d, []).append(i)
        ready, found = [i for i in ids if not waiting[i]], {}
        while ready:
            i = ready.pop()
            found[i] = most[i]
            for j in after.get(i, []):
                most[j] = max(most[j], most[i] + 1)
                waiting[j] -= 1
                if not waiting[j]:
                    ready.append(j)
        return pa.table({"number": pa.array([*found], pa.int64()), "level": pa.array([*found.values()], pa.int64())})

    found, before = calls.sparkSession.createDataFrame([], "number long, level long"), -1
    while True:
        given = outside.join(found, F.col("dep") == F.col("number")).select("block", "dep", "level")
        after = stored(nodes.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(ordered, "number long, level long"))
        n = after.count()
        if n == before:
            break
        if before >= 0:
            drop_stored(found)
        found, before = after, n
    out = own.join(found, "number", "left").join(unknown, "number", "left")
    return out.select("conv_id", "call_id", "level", F.coalesce("unknown", F.lit(0)).alias("unknown"))


def format_calls(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS, group: int = GROUP) -> DataFrame:
    """A row for each call and for each result without a call: conv_id, call_id, turn, level,
    result_turn, status (linked, open or orphan), valid, errors and the line of canonical JSON."""
    calls = stored(first_of(calls, "tool", "arguments", "depends_on", "notes"))
    results = first_of(results, "content").select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content", F.col("copies").alias("result_copies"))
    ordered = calls.join(levels(calls, group), ["conv_id", "call_id"])
    both = ordered.join(results, ["conv_id", "call_id"], "full_outer")
    names = ["conv_id", "call_id", "turn", "level", "result_turn", "status", "valid", "errors", "line"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.string()]

    def written(batches):
        fields = ("conv_id", "call_id", "turn", "place", "tool", "arguments", "depends_on", "notes", "copies", "level", "unknown", "result_turn", "content", "result_copies")
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for conv, call, turn, _, tool, arguments, needs, notes, copies, level, unknown, result_turn, content, result_copies in zip(*(batch.column(c).to_pylist() for c in fields), strict=True):
                errors = []
                if turn is not None:
                    value = json.loads(arguments)
                    errors = faults(value, schemas[tool]) if tool in schemas else [f"tool {tool}: unknown"]
                    errors += notes or []
                    errors += [f"identifier used {copies} times"] if copies > 1 else []
                    errors += ["depends in a circle"] if level is None else []
                    errors += [f"depends on {unknown} unknown calls"] if unknown else []
                    errors += ["result before its call"] if result_turn is not None and result_turn <= turn else []
                errors += [f"answered {result_copies} times"] if (result_copies or 0) > 1 else []
                status = "orphan" if turn is None else "open" if result_turn is None else "linked"
                line = {"conversation": conv, "id": call, "status": status}
                if turn is not None:
                    line |= {"arguments": value, "depends_on": sorted(needs), "name": tool}
                if content is not None:
                    line["result"] = json.loads(content)
                row = (conv, call, turn, level, result_turn, status, not errors and turn is not None, errors, canonical(line))
                for to, v in zip(out, row, strict=True):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=names)

    return both.mapInArrow(written, "conv_id long, call_id string, turn long, level long, result_turn long, status string, valid boolean, errors array<string>, line string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_calls(*calls_and_results(table(spark, sf_dir, "conversations"))).withColumn("errors", F.array_join("errors", "; "))
