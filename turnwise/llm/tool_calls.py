"""Chat formatting: calls and results of tools linked by identifier, in order, checked, as canonical JSON.

Calls and results are joined on (conversation, identifier). A call may name earlier calls it needs; messages are
sorted so that every call follows what it needs and every result its call. The sort key is the turn, lifted
over the turns of what a message needs, so logs that are in order already take one round, and no round
holds a whole conversation in one task. Arguments are checked against the schema of their tool.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.written import written

KINDS = {
    "string": (str,),
    "integer": (int,),
    "number": (int, float),
    "boolean": (bool,),
    "array": (list,),
    "object": (dict,),
}


def canonical(value) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fault(value, schema: Mapping, place: str = "$") -> str | None:
    """The first way in which ``value`` breaks a schema: type, required, properties, items, enum, minimum, maximum."""
    kind = schema.get("type")
    if kind and (not isinstance(value, KINDS[kind]) or (isinstance(value, bool) and kind != "boolean")):
        return f"{place}: not {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{place}: not in enum"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            return f"{place}: below minimum"
        if value > schema.get("maximum", value):
            return f"{place}: above maximum"
    if isinstance(value, dict):
        for name in sorted(schema.get("required", ())):
            if name not in value:
                return f"{place}.{name}: missing"
        known = schema.get("properties", {})
        for name in sorted(value):
            if name in known:
                found = fault(value[name], known[name], f"{place}.{name}")
                if found:
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{place}.{name}: unknown"
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            found = fault(item, schema["items"], f"{place}[{i}]")
            if found:
                return found
    return None


def _checked(schemas: Mapping[str, Mapping]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            rows = batch.to_pylist()
            errors, messages = [], []
            for row in rows:
                error, body = None, {"role": row["role"]}
                if row["kind"] == "call":
                    try:
                        arguments = json.loads(row["content"]) if row["content"] is not None else None
                    except ValueError:
                        arguments, error = row["content"], "$: not JSON"
                    if error is None:
                        schema = schemas.get(row["name"])
                        error = "unknown tool" if schema is None else fault(arguments, schema)
                    body |= {"arguments": arguments, "id": row["call_id"], "name": row["name"]}
                elif row["kind"] == "result":
                    body |= {"content": row["content"], "id": row["call_id"]}
                else:
                    body |= {"content": row["content"]}
                errors.append(error)
                messages.append(canonical(body))
            kept = [batch.column(names.index(n)) for n in ("conv_id", "turn", "order_turn", "order_hop", "kind", "call_id", "link")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(errors, pa.string()), pa.array(messages, pa.string())],
                ["conv_id", "turn", "order_turn", "order_hop", "kind", "call_id", "link", "error", "message"],
            )

    return run


def _ordered(messages: DataFrame, needs: DataFrame) -> DataFrame:
    """``messages`` with ``order_turn``, ``order_hop``: a key that puts each message behind what it needs.

    Each round lifts the messages that stand before something they need, and goes on with the conversations in which one
    was lifted. Messages in a circle of needs never settle: a conversation is left as it is after as many rounds as it has
    messages, which is more than any order without a circle takes, so other conversations neither add nor lose a round.
    """
    first = messages.select("conv_id", "message_id", F.struct("turn", F.lit(0).cast("long").alias("hop")).alias("key"))
    sizes = messages.groupBy("conv_id").agg(F.count("*").alias("rounds"))
    open_ = written(first.join(sizes.where("conv_id IS NOT NULL"), "conv_id", "left"), "order")
    settled = []
    done = 0
    while True:
        needed = needs.join(
            open_.select("conv_id", F.col("message_id").alias("needed"), F.col("key").alias("before")), ["conv_id", "needed"]
        )
        after = needed.groupBy("conv_id", "message_id").agg(F.max("before").alias("before"))
        lifted = open_.join(after, ["conv_id", "message_id"], "left").withColumn(
            "next", F.struct(F.col("before.turn").alias("turn"), (F.col("before.hop") + 1).alias("hop"))
        )
        late = F.coalesce(F.col("before").isNotNull() & (F.col("next") > F.col("key")), F.lit(False))
        moved = lifted.select(
            "conv_id", "message_id", F.when(late, F.col("next")).otherwise(F.col("key")).alias("key"), "rounds", late.alias("moved")
        )
        moved = written(moved, "order")
        done += 1
        going = moved.where(F.col("moved") & (F.col("rounds") > done)).select("conv_id").distinct()
        settled.append(moved.join(going, "conv_id", "left_anti").select("conv_id", "message_id", "key"))
        if going.isEmpty():
            break
        open_ = written(moved.join(going, "conv_id", "left_semi").drop("moved"), "order")
    keys = reduce(DataFrame.unionByName, settled)
    return messages.join(keys, ["conv_id", "message_id"]).select(
        messages["*"], F.col("key.turn").alias("order_turn"), F.col("key.hop").alias("order_hop")
    )


def format_tool_calls(messages: DataFrame, needs: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """One row per message, with its place, its link and its canonical JSON.

    ``messages``: ``conv_id``, ``turn``, ``role``, ``kind`` (``call``, ``result`` or anything else), ``call_id``, ``name`` (of the
    tool), ``content`` (arguments of a call as JSON, text otherwise). ``needs``: ``conv_id``, ``call_id``, ``needed`` (the identifier of a
    call whose result comes first). Returns ``conv_id``, ``turn``, ``order_turn``, ``order_hop``, ``kind``, ``call_id``, ``link``, ``error``, ``message``;
    sorting a conversation by ``order_turn, order_hop, turn`` gives the linked order.

    ``link``: ``linked``, ``unanswered`` (a call without a result), ``orphan`` (a result without a call), ``repeated`` (the identifier
    has several calls or several results), null for other messages and for a null identifier (a call without one is ``unanswered``, a
    result ``orphan``). ``error``: the first fault of the arguments. Null texts become JSON null. Needs that name no call of
    the conversation are ignored; a circle of needs ends with an order that is no more than stable. Repeated rows stay.
    An empty table gives an empty result.
    """
    counts = messages.where("call_id IS NOT NULL AND kind IN ('call', 'result')").groupBy("conv_id", "call_id").agg(
        F.count_if(F.col("kind") == "call").alias("calls"), F.count_if(F.col("kind") == "result").alias("results")
    )
    tagged = messages.withColumn("message_id", F.concat_ws("/", "kind", "call_id"))
    linked = tagged.join(counts, ["conv_id", "call_id"], "left")
    calls, results = F.coalesce("calls", F.lit(0)), F.coalesce("results", F.lit(0))
    link = (
        F.when((F.col("kind") == "call") & (results == 0), "unanswered")
        .when((F.col("kind") == "result") & (calls == 0), "orphan")
        .when(F.col("kind").isin("call", "result"), F.when((calls > 1) | (results > 1), "repeated").otherwise("linked"))
    )
    linked = linked.withColumn("link", link).drop("calls", "results")
    tied = linked.where(F.col("kind").isin("call", "result") & F.col("call_id").isNotNull())
    rest = linked.where(~(F.col("kind").isin("call", "result") & F.col("call_id").isNotNull()) | F.col("kind").isNull())
    places = tied.groupBy("conv_id", "message_id").agg(F.min("turn").alias("turn"))
    own = counts.where("calls > 0 AND results > 0").select(
        "conv_id", F.concat(F.lit("result/"), "call_id").alias("message_id"), F.concat(F.lit("call/"), "call_id").alias("needed")
    )
    asked = needs.where("call_id <> needed").select(
        "conv_id", F.concat(F.lit("call/"), "call_id").alias("message_id"), F.explode(
            F.array(F.concat(F.lit("result/"), "needed"), F.concat(F.lit("call/"), "needed"))
        ).alias("needed"),
    )
    order = _ordered(places, written(own.union(asked).distinct(), "needs"))
    placed = tied.join(order.drop("turn"), ["conv_id", "message_id"])
    other = rest.withColumns({"order_turn": F.col("turn"), "order_hop": F.lit(0).cast("long")})
    columns = ["conv_id", "turn", "order_turn", "order_hop", "kind", "call_id", "link", "role", "name", "content"]
    whole = placed.select(*columns).union(other.select(*columns))
    return whole.mapInArrow(
        _checked(schemas),
        "conv_id long, turn long, order_turn long, order_hop long, kind string, call_id string, link string, error string, message string",
    )


# The tool of the registered query.
SCHEMAS = {
    "answer": {
        "type": "object",
        "required": ["chars", "text"],
        "properties": {"chars": {"type": "integer", "minimum": 0, "maximum": 400}, "text": {"type": "string"}},
        "additionalProperties": False,
    }
}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls, results and needs derived from plain conversations.

    An assistant turn is a call of ``answer`` with its length and text as arguments; the user turn right after it
    is the result; the call two turns before is needed. The identifier is made of conversation and turn.
    """
    def name(turn):
        return F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))

    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").cast("string").alias("text")
    )
    is_call = F.coalesce(F.col("role") == "assistant", F.lit(False))
    is_result = F.coalesce((F.col("role") == "user") & (F.col("turn") > 0), F.lit(False))
    arguments = F.to_json(F.struct(F.length("text").alias("chars"), F.col("text")))
    messages = rows.select(
        "conv_id",
        "turn",
        "role",
        F.when(is_call, "call").when(is_result, "result").otherwise("text").alias("kind"),
        F.when(is_call, name(F.col("turn"))).when(is_result, name(F.col("turn") - 1)).alias("call_id"),
        F.when(is_call, "answer").alias("name"),
        F.when(is_call, arguments).otherwise(F.col("text")).alias("content"),
    )
    needs = rows.where(is_call & (F.col("turn") >= 2)).select(
        "conv_id", name(F.col("turn")).alias("call_id"), name(F.col("turn") - 2).alias("needed")
    )
    return messages, needs
