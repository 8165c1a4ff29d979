"""Tool calls in conversations: linked with results, ordered, validated, written as canonical JSON.

Calls and results are hash-joined by conversation and identifier. Calls that use other calls are
put into topological levels: a call's level is one more than the highest level it depends on. Levels
are found in rounds over the dependency edges, all conversations at once: an edge to a call whose level
is known becomes a number, and an edge to a call with one edge left is replaced by one past it, so that
a chain of n calls takes about log2(n) rounds. Arguments are checked against the tool's schema. Each message becomes one canonical JSON line: sorted keys, no blanks,
characters as they are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.functions.session import materialise, release, scratch_path

_TYPES = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
    "null": lambda v: v is None,
}


_MOST_STEPS = 1 << 40  # edges around a cycle grow longer with every round


def valid(value: object, schema: dict) -> bool:
    """The part of JSON Schema that tool arguments use: type, enum, minimum, maximum, properties,
    required, additionalProperties, items. Unknown keywords are ignored."""
    kinds = schema.get("type")
    if kinds is not None and not any(_TYPES[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return False
    if "enum" in schema and value not in schema["enum"]:
        return False
    if _TYPES["number"](value) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        return False
    if isinstance(value, list) and "items" in schema:
        return all(valid(v, schema["items"]) for v in value)
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if any(name not in value for name in schema.get("required", ())):
            return False
        if schema.get("additionalProperties") is False and any(name not in known for name in value):
            return False
        return all(valid(v, known[name]) for name, v in value.items() if name in known)
    return True


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _levels(calls: DataFrame, uses: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls that no cycle holds up; level 0 uses no other call.

    An open call's level is the greater of ``least`` and, over its edges, the other call's level plus
    ``steps``. Each round reads the tables that the last one wrote, of a row per open call and per edge.
    """
    key, none = ["conv_id", "call_id"], F.lit(0).cast("long")
    edges = uses.join(calls.select("conv_id", F.col("call_id").alias("used")), ["conv_id", "used"], "left_semi")
    edges = materialise(edges.distinct().select(*key, "used", F.lit(1).cast("long").alias("steps"), none.alias("least")), "uses")
    left = edges.groupBy(*key).agg(F.count("*").alias("edges"))
    state = materialise(calls.withColumn("least", none).join(left, key, "left"), "open-calls")
    path, number = scratch_path(calls.sparkSession, "levels"), 0
    while True:
        # Some open call uses none but known ones, unless all of them depend on a cycle.
        known = state.filter("edges is null").select(*key, F.col("least").alias("level"))
        if known.isEmpty():
            break
        known.write.parquet(f"{path}/round={number}")
        met = edges.join(known.withColumnRenamed("call_id", "used"), ["conv_id", "used"], "left")
        met = materialise(met.withColumn("least", F.greatest("least", F.col("steps") + F.col("level"))), "met")
        release(edges)
        rest = F.col("level").isNull()
        left = met.groupBy(*key).agg(
            F.max("least").alias("found"), F.count(F.when(rest, 1)).alias("edges"),
            F.min(F.when(rest, F.struct("used", "steps"))).alias("edge"))
        before, state = state, materialise(state.filter("edges is not null").select(*key, "least").join(left, key, "left").select(
            *key, F.greatest("least", "found").alias("least"), F.nullif("edges", F.lit(0)).alias("edges"), "edge"), "open-calls")
        release(before)
        passed = state.filter("edges = 1").select(
            "conv_id", F.col("call_id").alias("used"), F.col("least").alias("lower"),
            F.col("edge.used").alias("beyond"), F.col("edge.steps").alias("more"))
        moved = met.filter(rest).join(passed, ["conv_id", "used"], "left").select(
            *key, F.coalesce("beyond", "used").alias("used"),
            F.least(F.col("steps") + F.coalesce("more", none), F.lit(_MOST_STEPS)).alias("steps"),
            F.greatest("least", F.col("steps") + F.col("lower")).alias("least"))
        edges = materialise(moved.groupBy(*key, "used").agg(F.max("steps").alias("steps"), F.max("least").alias("least")), "uses")
        release(met)
        number += 1
    kinds = ", ".join(f"{c} {calls.schema[c].dataType.simpleString()}" for c in key)
    if not number:
        return calls.sparkSession.createDataFrame([], f"{kinds}, level long")
    return calls.sparkSession.read.schema(f"{kinds}, level long").parquet(*(f"{path}/round={k}" for k in range(number)))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Link, order and check tool calls.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), uses (array of call ids).
    ``results``: conv_id, turn, call_id, content. Other columns are not read.

    Returns a row per call and per result: conv_id, call_id, kind (call or result), turn, level,
    status, message. Order within a conversation is (level, call_id, kind). Status of a call: linked,
    unanswered, duplicate (its id was called before, at an earlier turn or equal turn and smaller
    text), cycle (level null), no_id (null identifier), and invalid when its arguments are no JSON
    object, its tool is unknown, or the schema rejects them. Status of a result: linked, duplicate,
    or orphan when no call has its id. An identifier in ``uses`` that no call has is ignored; a call
    that uses itself is a cycle. Equal rows stay as duplicates.
    """
    spark = calls.sparkSession
    key = ["conv_id", "call_id"]
    kind = calls.schema["conv_id"].dataType.simpleString()
    calls = materialise(calls.select("conv_id", "turn", "call_id", "name", "arguments", "uses"), "calls")
    results = results.select("conv_id", "turn", "call_id", "content")
    # The first of equal ids is the call; struct order is turn, then the rest.
    order = F.struct("turn", F.coalesce("name", F.lit("")), F.coalesce("arguments", F.lit("")))
    first_call = calls.filter("call_id is not null").groupBy(*key).agg(
        F.min(F.struct(order.alias("o"), "turn", "name", "arguments", "uses")).alias("c"), F.count("*").alias("calls"))
    answers = results.filter("call_id is not null").groupBy(*key).agg(
        F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("answers"))
    linked = materialise(first_call.join(answers, key, "full_outer"), "linked")
    uses = linked.filter("calls is not null").select(*key, F.explode("c.uses").alias("used")).filter("used is not null")
    levels = _levels(linked.filter("calls is not null").select(*key), uses)
    linked = linked.join(levels, key, "left")

    one = F.lit(1).cast("long")
    of_call = linked.filter("calls is not null").select(
        *key, F.lit("call").alias("kind"), F.col("c.turn").alias("turn"), "level",
        F.when(F.col("level").isNull(), "cycle").when(F.col("answers").isNull(), "unanswered").otherwise("linked").alias("status"),
        F.col("c.name").alias("name"), F.col("c.arguments").alias("body"), one.alias("copies"))
    again_call = linked.filter("calls > 1").select(*key, "level", (F.col("calls") - 1).alias("more"))
    later_calls = calls.join(again_call, key).join(
        first_call.select(*key, F.col("c.o").alias("o")), key).select(
        *key, F.lit("call").alias("kind"), "turn", "level", F.lit("duplicate").alias("status"), "name",
        F.col("arguments").alias("body"), (order == F.col("o")).alias("same"))
    # Of rows equal to the first one, all but one are duplicates.
    later_calls = later_calls.groupBy(*key, "kind", "turn", "level", "status", "name", "body", "same").agg(
        (F.count("*") - F.when(F.col("same"), 1).otherwise(0)).alias("copies")).drop("same").filter("copies > 0")
    nameless = calls.filter("call_id is null").select(
        *key, F.lit("call").alias("kind"), "turn", F.lit(None).cast("int").alias("level"), F.lit("no_id").alias("status"),
        "name", F.col("arguments").alias("body"), one.alias("copies"))

    shown = linked.select(*key, "level", F.col("r").alias("first"), F.col("calls").isNotNull().alias("known"))
    each = results.groupBy("conv_id", "call_id", "turn", "content").agg(F.count("*").alias("n"))
    each = each.join(shown, key, "left").withColumn(
        "is_first", F.coalesce(F.struct("turn", "content").eqNullSafe(F.col("first")), F.lit(False)))

    def result_rows(status: str, copies, rows: DataFrame) -> DataFrame:
        return rows.select(*key, F.lit("result").alias("kind"), "turn", "level", F.lit(status).alias("status"),
                           F.lit(None).cast("string").alias("name"), F.col("content").alias("body"), copies.alias("copies"))

    known = F.coalesce("known", F.lit(False))
    of_result = result_rows("linked", one, each.filter(known & F.col("is_first"))).unionByName(
        result_rows("duplicate", F.col("n") - F.when(F.col("is_first"), 1).otherwise(0), each.filter(known))).unionByName(
        result_rows("orphan", F.col("n"), each.filter(~known)))
    rows = of_call.unionByName(later_calls).unionByName(nameless).unionByName(of_result).filter("copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "copy")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status, message = [], []
            for row in batch.select(["call_id", "kind", "status", "name", "body"]).to_pylist():
                state = row["status"]
                if row["kind"] == "call":
                    try:
                        body = json.loads(row["body"] or "")
                    except ValueError:
                        body = row["body"]
                    schema = schemas.get(row["name"])
                    if state in ("linked", "unanswered") and (
                            schema is None or not isinstance(body, dict) or not valid(body, schema)):
                        state = "invalid"
                    text = {"role": "assistant", "tool_calls": [
                        {"id": row["call_id"], "type": "function", "function": {"name": row["name"], "arguments": body}}]}
                else:
                    text = {"role": "tool", "tool_call_id": row["call_id"], "content": row["body"]}
                status.append(state)
                message.append(canonical(text))
            columns = {c: batch.column(c) for c in ("conv_id", "call_id", "kind", "turn", "level")}
            yield pa.RecordBatch.from_pydict(
                columns | {"status": pa.array(status, pa.string()), "message": pa.array(message, pa.string())})

    turn = calls.schema["turn"].dataType.simpleString()
    return rows.withColumn("level", F.col("level").cast("int")).mapInArrow(
        write, f"conv_id {kind}, call_id string, kind string, turn {turn}, level int, status string, message string")


# The table of conversations has no tool calls of its own. Each user turn is taken as a call of a
# tool "reply", which uses the user or system turn before it, and each assistant turn as a result for
# the turn in front of it; a system turn is a call of "configure", which takes short texts only.
SCHEMAS = {
    "reply": {"type": "object", "required": ["text", "words"], "additionalProperties": False,
              "properties": {"text": {"type": "string"}, "words": {"type": "integer", "minimum": 1, "maximum": 60}}},
    "configure": {"type": "object", "required": ["text", "words"],
                  "properties": {"text": {"type": "string"}, "words": {"type": "integer", "maximum": 20}}},
}


def _turns_before(turns: DataFrame) -> DataFrame:
    """conv_id, turn and the next smaller turn of the conversation, without sorting one in a single task.

    Turns are dealt out by ranges; a conversation's first turn in a range takes the last one of the
    ranges before, of which there is a row per range and conversation.
    """
    ranged = turns.filter("conv_id is not null and turn is not null").distinct().repartitionByRange("conv_id", "turn")
    ranged = materialise(ranged.withColumn("part", F.spark_partition_id()), "turns")
    inside = F.lag("turn").over(Window.partitionBy("conv_id", "part").orderBy("turn"))
    last = ranged.groupBy("conv_id", "part").agg(F.max("turn").alias("last"))
    carried = last.select("conv_id", "part", F.lag("last").over(Window.partitionBy("conv_id").orderBy("part")).alias("carried"))
    return ranged.withColumn("inside", inside).join(carried, ["conv_id", "part"]).select(
        "conv_id", "turn", F.coalesce("inside", "carried").alias("before"))


def calls_of_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table conv_id, turn, role, text, by the rule above."""
    name = F.when(F.col("role") == "system", "configure").otherwise("reply")
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""))

    def named(turn: Column) -> Column:
        return F.concat(F.lit("t"), turn.cast("string"))

    asked = conversations.filter(F.col("role").isin("user", "system"))
    before = _turns_before(asked.select("conv_id", "turn"))
    calls = asked.select("conv_id", "turn", "role", "text").join(before, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", named(F.col("turn")).alias("call_id"), name.alias("name"),
        F.to_json(F.struct("text", words.alias("words"))).alias("arguments"),
        F.when(F.col("before").isNotNull(), F.array(named(F.col("before")))).otherwise(
            F.expr("cast(array() as array<string>)")).alias("uses"))
    results = conversations.filter(F.col("role") == "assistant").select(
        "conv_id", "turn", named(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


ORACLE = r"""
with base as (
  select conv_id, turn, role, text,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) as words
  from conversations),
calls as (
  select *, count(*) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as level
  from base where role in ('user', 'system')),
results as (select conv_id, turn, text, turn - 1 as of_turn from base where role = 'assistant'),
shown as (
  select c.conv_id, 't' || c.turn as call_id, 'call' as kind, c.turn, c.level::int as level,
         case when c.text is null or c.role = 'user' and c.words not between 1 and 60 or c.role = 'system' and c.words > 20 then 'invalid'
              when r.turn is null then 'unanswered' else 'linked' end as status,
         '{"role":"assistant","tool_calls":[{"function":{"arguments":{' ||
           case when c.text is null then '' else '"text":' || to_json(c.text) || ',' end || '"words":' || c.words || '},"name":"' ||
           case when c.role = 'system' then 'configure' else 'reply' end || '"},"id":"t' || c.turn || '","type":"function"}]}' as message
  from calls c left join results r on r.conv_id = c.conv_id and r.of_turn = c.turn
  union all
  select r.conv_id, 't' || r.of_turn, 'result', r.turn, c.level::int,
         case when c.turn is null then 'orphan' else 'linked' end,
         '{"content":' || coalesce(to_json(r.text)::varchar, 'null') || ',"role":"tool","tool_call_id":"t' || r.of_turn || '"}'
  from results r left join calls c on r.conv_id = c.conv_id and r.of_turn = c.turn)
select * from shown
"""
