"""Tool-call linking for chat transcripts, with DataFrame functions only.

Messages: (conv_id, turn, role, name, call_id, text). A message with role ``call`` carries the JSON arguments of tool ``name`` in its text, one with role
``tool`` the result of the call of the same ``call_id``; all others are said. A hash join links results to calls by (conv_id,
call_id). The order is topological: a call stands by its turn, its result directly behind it whatever the result's own turn was, so no result precedes
its call; all others keep their turn. Arguments are held against the tool's schema: required names, kinds, bounds, no names besides. Each message
becomes canonical JSON: keys in sorted order, no white space, keys without a value left out; a call's content is its arguments, in canonical JSON too.

Cases: a result without a call keeps its turn and is marked an orphan; a call without a result is marked open; of several calls with one id the first by
turn, and at one turn the one with the least hash of name and text, is the call and the others are marked repeated (rows that repeat the call itself are the call);
several results of one call follow it by turn; a null call_id links nothing; arguments that
are no JSON object (or name a key twice) are invalid and stay as they were written; tools without a schema are unknown; a null text is written as the empty text; empty tables give an empty result.
An identifier may have any share of all messages: its rows are dealt to many tasks where they meet their call (``skew.join_one``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import hot_keys, join_one
from .storage import Workspace

#: JSON kind -> what a value of it looks like once read as text from a map of raw values.
_KIND = {
    "string": lambda v: v.startswith('"'),
    "integer": lambda v: v.rlike(r"^-?(0|[1-9][0-9]*)$"),
    "number": lambda v: v.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?$"),
    "boolean": lambda v: v.isin("true", "false"),
    "object": lambda v: v.startswith("{"),
    "array": lambda v: v.startswith("["),
}
_RULE = re.compile(r"(\w+)(\?)?(?:>=(\d+))?(?:<=(\d+))?")


def _arguments(text: Column) -> Column:
    """Top-level names and raw JSON values; null if the text is no JSON object."""
    parsed = F.try_parse_json(text)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    keys = F.json_object_keys(text)
    pairs = F.transform(keys, lambda k: F.struct(k.alias("key"), F.to_json(F.try_variant_get(parsed, F.lit("$"), "map<string,variant>")[k]).alias("value")))
    return F.when(is_object, F.coalesce(F.map_from_entries(pairs), F.create_map().cast("map<string,string>")))


def canonical(text: Column) -> Column:
    """A JSON object with sorted keys at every depth and no white space; null if the text is none. Variants keep their keys sorted."""
    parsed = F.try_parse_json(text)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), F.to_json(parsed))


def linked(messages: DataFrame, space: Workspace | None = None) -> DataFrame:
    """``messages`` (conv_id, turn, role, name, call_id, text) with at (the turn that orders it), step (0, or 1 for a result at its call) and state: said, call, open, repeated, result or orphan."""
    space = space or Workspace(messages.sparkSession)
    m = messages.select("conv_id", "turn", "role", "name", "call_id", "text")
    is_call = F.col("role") == "call"
    tie = F.struct("turn", F.xxhash64("name", "text").alias("h"))
    plain = m.where("role not in ('call', 'tool') or call_id is null or role is null or conv_id is null")
    named = m.where("role in ('call', 'tool') and call_id is not null and conv_id is not null")
    calls = named.groupBy("conv_id", "call_id").agg(F.min(F.when(is_call, tie)).alias("first"), F.count_if(F.col("role") == "tool").alias("n_results"), F.count("*").alias("n"))
    calls = space.written(calls, "calls")
    tied = join_one(named, calls.drop("n"), ["conv_id", "call_id"], space.written(hot_keys(calls, ["conv_id", "call_id"]), "hot"), "left", "shuffle_hash")
    first = tie.eqNullSafe(F.col("first"))
    state = (
        F.when(is_call & ~first, "repeated")
        .when(is_call & (F.col("n_results") == 0), "open")
        .when(is_call, "call")
        .when(F.col("first").isNull(), "orphan")
        .otherwise("result")
    )
    tied = tied.withColumn("state", state).withColumn("at", F.when(F.col("state") == "result", F.col("first.turn")).otherwise(F.col("turn"))).withColumn("step", F.when(F.col("state") == "result", 1).otherwise(0))
    alone = F.when(F.col("role") == "call", "open").when(F.col("role") == "tool", "orphan").otherwise("said")
    plain = plain.withColumn("state", alone).withColumn("at", F.col("turn")).withColumn("step", F.lit(0))
    cols = ["conv_id", "turn", "role", "name", "call_id", "text", "at", "step", "state"]
    return tied.select(cols).unionByName(plain.select(cols))


def validity(text: Column, name: Column, schemas: dict[str, dict[str, str]]) -> Column:
    """ok, unknown (tool), invalid (no object), missing:, kind:, bounds: or extra: and the first such argument's name. ``schemas``: tool -> argument -> kind, then ? if
    optional, then bounds as >=n and <=n: of a number's value or a text's length in characters."""
    args = _arguments(text)
    out = F.when(~F.coalesce(name.isin(*schemas), F.lit(False)), "unknown").when(args.isNull(), "invalid")
    for tool, fields in schemas.items():
        here = name == tool
        for f, rule in sorted(fields.items()):
            kind, optional, low, high = _RULE.fullmatch(rule).groups()
            v = args[f]
            if not optional:
                out = out.when(here & v.isNull(), f"missing:{f}")
            out = out.when(here & v.isNotNull() & ~_KIND[kind](v), f"kind:{f}")
            size = F.length(F.from_json(F.concat(F.lit("["), v, F.lit("]")), "array<string>")[0]) if kind == "string" else v.try_cast("double")
            for bound, outside in ((low, lambda x, b: x < b), (high, lambda x, b: x > b)):
                if bound is not None:
                    out = out.when(here & v.isNotNull() & outside(size, int(bound)), f"bounds:{f}")
        extra = F.array_sort(F.array_except(F.map_keys(args), F.array(*(F.lit(f) for f in fields)).cast("array<string>")))
        out = out.when(here & (F.size(extra) > 0), F.concat(F.lit("extra:"), extra[0]))
    return out.otherwise("ok")


def formatted(messages: DataFrame, schemas: dict[str, dict[str, str]], space: Workspace | None = None) -> DataFrame:
    """One row a message: conv_id, at, step, turn (in this order the messages of a conversation are topologically sorted), state, valid (calls only)
    and message, its canonical JSON. Conversations are not gathered into rows, as one may hold any share of all messages; ``transcript`` does that."""
    rows = linked(messages, space).withColumn("valid", F.when(F.col("role") == "call", validity(F.col("text"), F.col("name"), schemas)))
    text = F.coalesce("text", F.lit(""))
    content = F.when(F.col("role") == "call", F.coalesce(canonical(text), text)).otherwise(text)
    # the struct's fields stand in sorted order, and to_json leaves out nulls
    one = F.struct("call_id", content.alias("content"), "name", "role", "state", "valid")
    return rows.select("conv_id", "at", "step", "turn", "state", "valid", F.to_json(one).alias("message"))


def transcript(formatted: DataFrame) -> DataFrame:
    """conv_id and chat, one canonical JSON text a conversation. A conversation must fit into a row."""
    order = F.array_sort(F.collect_list(F.struct("at", "step", "turn", "message")))
    chat = F.concat(F.lit('{"messages":['), F.array_join(F.transform(order, lambda x: x["message"]), ","), F.lit("]}"))
    return formatted.groupBy("conv_id").agg(chat.alias("chat"))


#: The tool that plain transcripts are read as calls of: questions of at most 256 characters and at least three words.
ASK = {"reply": {"characters": "integer", "question": "string<=256", "words": "integer>=3"}}


def asked(conversations: DataFrame) -> DataFrame:
    """Plain transcripts (conv_id, turn, role, text) as tool messages: a user's turn is a call of ``reply`` whose arguments are the question and its size, an assistant's turn
    the result of the call in the turn before it, by an identifier that both turns give; other roles are said."""
    text = F.coalesce("text", F.lit(""))
    call = F.col("role") == "user"
    result = F.col("role") == "assistant"
    asks = F.when(call, F.col("turn")).when(result, F.col("turn") - 1)
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    arguments = F.to_json(F.struct(F.length(text).alias("characters"), text.alias("question"), words.alias("words")))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(call, "call").when(result, "tool").otherwise(F.col("role")).alias("role"),
        F.when(call | result, "reply").alias("name"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("t"), asks.cast("string")).alias("call_id"),
        F.when(call, arguments).otherwise(text).alias("text"),
    )
