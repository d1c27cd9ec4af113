"""Chat formatting: tool calls linked with their results, ordered, validated, as canonical JSON.

DataFrame functions only.

A call is a JSON object between <tool_call> and </tool_call> in a message's
text: {"id": ..., "name": ..., "arguments": {...}}; a result is one between
<tool_result> and </tool_result>: {"id": ..., "content": ...}. Plain turns
link by place: a user turn is a call whose identifier is its number, and the
assistant turn that follows it by number is its result.

* Calls and results are hash-joined on conversation and identifier. Of calls
  of one identifier the first by turn and place counts, of results the first
  that doesn't come before its call's turn; others are duplicates, or results of
  nothing, and stay unlinked.
* Calls are ordered topologically: a call whose arguments hold "$ref:ID" comes
  after the call of that identifier. Levels are found round by round; calls in
  a cycle, or behind one, get the level -1.
* Arguments are validated against the tool's schema (required names and types
  of parameters); a tool without a schema is unknown.
* The JSON of a message has its keys in order of code points, no white space
  outside strings, and arguments likewise at all levels. A message with calls
  has all of them in order, each with what is known of its arguments, id, level,
  name and result; one that is unlinked has no level and no result.

A null text is empty, a null role "unknown". Malformed JSON is a call without
identifier and unlinked. Repeated rows link as duplicates. Rows with a null
conversation never link, results with a null turn neither. Messages stay rows of their own, so a conversation of
any length is never gathered in one task. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinity.llm.text import Scratch

CALL = r"(?s)<tool_call>(.*?)</tool_call>"
RESULT = r"(?s)<tool_result>(.*?)</tool_result>"
REFERENCE = r"\$ref:([A-Za-z0-9_.\-]+)"


def quoted(c: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("a"))), r'(?s)^\{"a":(.*)\}$', 1)


def canonical_arguments(arguments: Column) -> Column:
    """JSON without white space whose objects have their keys in order of code points, at all levels; null if malformed."""
    return F.to_json(F.try_parse_json(arguments))  # variants keep the fields of objects sorted


def messages(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls in role and text, and a hash for ties."""
    return turns.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )


def tool_parts(msgs: DataFrame, pattern: str, value: str) -> DataFrame:
    """conv_id, turn, place, id, name and the value (JSON) of each call or result in the texts."""
    tag = "<tool_call>" if pattern == CALL else "<tool_result>"
    found = msgs.where(F.contains("text", F.lit(tag))).select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("place", "j"))
    get = lambda k: F.get_json_object("j", f"$.{k}")
    return found.select("conv_id", "turn", "place", get("id").alias("id"), get("name").alias("name"), get(value).alias(value))


def first_of(parts: DataFrame) -> DataFrame:
    """The first part of each conversation and identifier; a hot identifier is pre-aggregated by the limit before the shuffle."""
    w = Window.partitionBy("conv_id", "id").orderBy("turn", "place", *[c for c in parts.columns if c not in ("conv_id", "id", "turn", "place")])
    return parts.where("id is not null and conv_id is not null").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def order_levels(calls: DataFrame) -> DataFrame:
    """conv_id, id, level: 0 for calls without references to known calls, else one more than the largest they refer to; -1 in or behind cycles."""
    known = calls.select("conv_id", "id").distinct()
    edges = calls.select("conv_id", "id", F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(REFERENCE), F.lit(1)))).alias("ref"))
    with Scratch(calls.sparkSession, "chat") as scratch:
        edges = scratch.save(edges.join(known.withColumnRenamed("id", "ref"), ["conv_id", "ref"], "left_semi"), "edges")
        if edges.isEmpty():
            return known.withColumn("level", F.lit(0))
        waiting = scratch.save(edges.select("conv_id", "id").distinct(), "waiting")
        ready, later, level = known.join(waiting, ["conv_id", "id"], "left_anti"), [], 0
        while True:  # only what still waits, and the calls of the last level, are read and written
            level += 1
            left = scratch.save(edges.join(ready.select("conv_id", F.col("id").alias("ref")), ["conv_id", "ref"], "left_anti"), "edges")
            now = waiting.join(left.select("conv_id", "id").distinct(), ["conv_id", "id"], "left_anti")
            ready = scratch.save(now.withColumn("level", F.lit(level)), "level", keep=True)
            if ready.isEmpty():
                break
            later.append(ready)
            scratch.drop(edges)
            edges, before = left, waiting
            waiting = scratch.save(waiting.join(ready, ["conv_id", "id"], "left_anti"), "waiting")
            scratch.drop(before)
        waiting = scratch.save(waiting.withColumn("level", F.lit(-1)), "cycles", keep=True)
        late = waiting
        for part in later:
            late = late.unionByName(part)
        return known.join(late, ["conv_id", "id"], "left").withColumn("level", F.coalesce("level", F.lit(0)))


#: A tool's schema: name, and parameters as rows of (parameter, type, required).
SCHEMA_ROWS = "name string, parameter string, type string, required boolean"
#: Variant types of each JSON type.
TYPE_PATTERNS = {"integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT", "string": "^STRING$"}


def validate(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls with validity: valid, invalid, or unknown (no schema of the name). schemas: SCHEMA_ROWS."""
    pattern = F.create_map(*[F.lit(x) for kv in TYPE_PATTERNS.items() for x in kv])
    need = schemas.groupBy("name").agg(F.collect_list(F.struct("parameter", "type", "required")).alias("parameters"))  # a tool's own parameters
    joined = calls.join(need, "name", "left")
    values = F.from_json("arguments", "map<string,variant>")
    kind = lambda p: F.schema_of_variant(F.element_at(values, p["parameter"]))
    fine = F.forall("parameters", lambda p: F.when(F.element_at(values, p["parameter"]).isNull(), ~p["required"]).otherwise(F.regexp_like(kind(p), F.coalesce(pattern[p["type"]], F.lit("^.*$")))))
    extra = F.exists(F.map_keys(values), lambda k: ~F.exists("parameters", lambda p: p["parameter"] == k))
    ok = F.when(F.col("parameters").isNull(), "unknown").when(values.isNull() | ~fine | extra, "invalid").otherwise("valid")
    return joined.withColumn("validity", ok).drop("parameters")


def link_calls(turns: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, id, name, arguments (canonical), call_turn, place, level, validity, result_turn, content of each call that has an identifier."""
    msgs = messages(turns)
    calls = first_of(tool_parts(msgs, CALL, "arguments"))
    results = tool_parts(msgs, RESULT, "content").join(calls.select("conv_id", "id", F.col("turn").alias("asked")), ["conv_id", "id"]).where("turn >= asked").drop("asked")
    results = first_of(results).select("conv_id", "id", F.col("turn").alias("result_turn"), "content")
    levels = order_levels(calls)
    linked = validate(calls, schemas).join(levels, ["conv_id", "id"], "left").join(results.hint("shuffle_hash"), ["conv_id", "id"], "left")
    return linked.select("conv_id", "id", "name", canonical_arguments(F.col("arguments")).alias("arguments"), F.col("turn").alias("call_turn"), "place", "level", "validity", "result_turn", "content")


def calls_json(text: Column, linked: Column) -> Column:
    """The JSON array of a text's calls in order; linked: structs of its turn's calls from link_calls."""

    def one(j: Column, i: Column) -> Column:
        id_, name, arguments = F.get_json_object(j, "$.id"), F.get_json_object(j, "$.name"), canonical_arguments(F.get_json_object(j, "$.arguments"))
        own = F.get(F.filter(linked, lambda x: (x["place"] == i) & (x["id"] == id_) & x["name"].eqNullSafe(name) & x["arguments"].eqNullSafe(arguments)), F.lit(0))
        field = lambda key, value, raw: F.when(value.isNotNull(), F.concat(F.lit(f'"{key}":'), raw))
        return F.concat(
            F.lit("{"),
            F.concat_ws(
                ",", field("arguments", arguments, arguments), field("id", id_, quoted(id_)), field("level", own["level"], own["level"].cast("string")),
                field("name", name, quoted(name)), field("result", own["content"], quoted(own["content"])),
            ),
            F.lit("}"),
        )

    return F.concat(F.lit("["), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(CALL), F.lit(1)), one), ","), F.lit("]"))


def format_chat(turns: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row a message: conv_id, turn, role, position, reply_to, answered_by, n_calls, n_linked, n_valid, max_level, json.

    position is the message's place when results follow their calls: a turn with a result is never before its call's.
    n_calls counts all calls of the text, n_linked and n_valid those of its turn that have an identifier of their own.
    """
    msgs = messages(turns)
    # plain turns: a user turn is answered by the assistant turn of the next number
    plain = lambda role: msgs.where(F.col("role") == role).where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("n"))
    asked = plain("user").select("conv_id", F.col("turn").alias("reply_to"), (F.col("turn") + 1).alias("answered_by"))
    pairs = plain("assistant").select("conv_id", F.col("turn").alias("answered_by")).join(asked.hint("shuffle_hash"), ["conv_id", "answered_by"])
    calls = link_calls(turns, schemas)
    stats = calls.groupBy("conv_id", F.col("call_turn").alias("turn")).agg(F.collect_list(F.struct("place", "id", "name", "arguments", "level", "content")).alias("calls"), F.count("result_turn").alias("linked"), F.count_if(F.col("validity") == "valid").alias("valid"), F.max("level").alias("max_level"))
    late = calls.where("result_turn is not null").groupBy("conv_id", F.col("result_turn").alias("turn")).agg(F.max("call_turn").alias("after"))
    out = msgs.join(pairs.select("conv_id", F.col("answered_by").alias("turn"), "reply_to"), ["conv_id", "turn"], "left")
    out = out.withColumn("reply_to", F.when(F.col("role") == "assistant", F.col("reply_to")))
    out = out.join(pairs.select("conv_id", F.col("reply_to").alias("turn"), "answered_by"), ["conv_id", "turn"], "left")
    out = out.withColumn("answered_by", F.when(F.col("role") == "user", F.col("answered_by")))
    out = out.join(stats, ["conv_id", "turn"], "left").join(late, ["conv_id", "turn"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    n_calls = F.when(F.contains("text", F.lit("<tool_call>")), F.size(F.regexp_extract_all("text", F.lit(CALL), F.lit(1)))).otherwise(F.lit(0)).cast("long")
    linked = F.coalesce("calls", F.array().cast(out.schema["calls"].dataType))
    body = F.concat(
        F.lit("{"), F.when(n_calls > 0, F.concat(F.lit('"calls":'), calls_json(F.col("text"), linked), F.lit(","))).otherwise(F.lit("")),
        F.lit('"content":'), quoted(F.col("text")),
        F.when(F.col("reply_to").isNotNull(), F.concat(F.lit(',"reply_to":'), F.col("reply_to").cast("string"))).otherwise(F.lit("")),
        F.lit(',"role":'), quoted(F.col("role")), F.lit("}"),
    )
    position = F.greatest(F.col("turn"), F.coalesce(F.col("after"), F.col("turn")))
    return out.select("conv_id", "turn", "role", position.alias("position"), "reply_to", "answered_by", n_calls.alias("n_calls"), zero("linked").alias("n_linked"), zero("valid").alias("n_valid"), "max_level", body.alias("json"))
