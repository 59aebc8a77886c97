"""Tool-call linking for chat records, in DataFrame operations only.

Calls and results meet in a hash join on (conversation, call id). Calls are ordered topologically:
an argument value "$id" (at any depth; not a key) needs the result of call `id` of the same
conversation, and a call's level is one more than the highest level it needs. Arguments are checked against a schema by name, and every
record is written as canonical JSON: keys sorted at every depth, no spaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import discard, materialise

# JSON types of a schema and the variant types that satisfy them.
TYPES = {
    "string": "^STRING$", "integer": "^(BIGINT|DECIMAL\\([0-9]+,0\\))$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": "^BOOLEAN$", "object": "^OBJECT.*$", "array": "^ARRAY.*$", "null": "^VOID$", "any": "^.*$",
}
SCHEMA_COLUMNS = "name string, params array<struct<name:string,type:string,required:boolean>>"


CALL = "struct<content:string,tool_calls:array<struct<id:string,name:string,arguments:variant>>>"


def holds_calls(text):
    """Is the text a JSON object with tool calls?"""
    return F.coalesce(F.size(F.from_json(text, CALL)["tool_calls"]) > 0, F.lit(False))


def extract_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, plain messages) of (conv_id, turn, role, text) rows.

    An assistant text that is a JSON object with `tool_calls` makes calls; a tool text that is a
    JSON object with `tool_call_id` is a result. Everything else, broken JSON included, is plain.
    """
    result = "struct<tool_call_id:string,content:variant>"
    rows = messages.select("conv_id", "turn", "role", "text").withColumn("call", F.when(F.col("role") == "assistant", F.from_json("text", CALL))).withColumn(
        "result", F.when(F.col("role") == "tool", F.from_json("text", result)))
    calls = rows.filter(F.size("call.tool_calls") > 0).select("conv_id", "turn", F.posexplode("call.tool_calls").alias("pos", "c")).select(
        "conv_id", "turn", "pos", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.to_json("c.arguments").alias("arguments"))
    results = rows.filter("result.tool_call_id is not null").select("conv_id", "turn", F.col("result.tool_call_id").alias("call_id"), F.to_json("result.content").alias("content"))
    plain = rows.filter("not coalesce(size(call.tool_calls) > 0, false) and result.tool_call_id is null").select("conv_id", "turn", "role", "text")
    return calls, results, plain


def validity(arguments, params):
    """'' if the arguments (JSON text) satisfy the parameters, else the first complaint, by kind and then name."""
    kinds = F.transform_values(F.from_json(arguments, "map<string,variant>", {"mode": "PERMISSIVE"}), lambda _, v: F.schema_of_variant(v))
    keys = F.json_object_keys(arguments)
    missing = F.array_sort(F.transform(F.filter(params, lambda p: p["required"] & ~F.array_contains(keys, p["name"])), lambda p: F.concat(F.lit("missing:"), p["name"])))
    unknown = F.array_sort(F.transform(F.array_except(keys, F.transform(params, lambda p: p["name"])), lambda k: F.concat(F.lit("unknown:"), k)))

    def wrong_type(p):
        ok = F.lit(False)
        for name, pattern in TYPES.items():
            ok = ok | ((p["type"] == name) & F.try_element_at(kinds, p["name"]).rlike(pattern))
        return F.array_contains(keys, p["name"]) & ~F.coalesce(ok, F.lit(False))

    mistyped = F.array_sort(F.transform(F.filter(params, wrong_type), lambda p: F.concat(F.lit("type:"), p["name"])))
    return (F.when(params.isNull(), F.lit("unknown tool")).when(keys.isNull(), F.lit("arguments are not an object"))
            .otherwise(F.coalesce(F.get(F.concat(missing, unknown, mistyped), F.lit(0)), F.lit(""))))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of distinct calls; level is null for calls on or behind a cycle.

    Calls with one need jump along their chain, twice as far in each round, to a call without needs
    or with several; whoever has not arrived after as many steps as there are such calls is on or
    behind a cycle. Only calls with several needs are settled one level a round. References to ids
    that are no call of the conversation are ignored.
    """
    spark = calls.sparkSession
    ids = calls.select("conv_id", "call_id")
    refs = (calls.select("conv_id", "call_id", F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(r'"\$([^"\\]+)"(?!\s*:)'), F.lit(1)))).alias("need"))
            .join(ids.withColumnRenamed("call_id", "need"), ["conv_id", "need"]))
    refs, refs_path = materialise(refs, "chat-refs")
    if refs.isEmpty():
        discard(spark, refs_path)
        return ids.withColumn("level", F.lit(0))
    needs = refs.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("need").alias("to"))
    single = needs.filter("n = 1").select("conv_id", "call_id", "to", F.lit(1).cast("long").alias("steps"))
    jumps, jumps_path = materialise(single.join(single.select("conv_id", F.col("call_id").alias("to"), F.lit(True).alias("open")), ["conv_id", "to"], "left").withColumn("open", F.coalesce("open", F.lit(False))), "chat-jumps")
    reach, total = 1, jumps.count()
    while reach <= total and not jumps.filter("open").isEmpty():
        ahead = jumps.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("far"), F.col("steps").alias("more"), F.col("open").alias("still"))
        moved = jumps.filter("open").join(ahead, ["conv_id", "to"]).select("conv_id", "call_id", F.col("far").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("still").alias("open"))
        after, path = materialise(jumps.filter("not open").select("conv_id", "call_id", "to", "steps", "open").unionByName(moved), "chat-jumps")
        discard(spark, jumps_path)
        jumps, jumps_path, reach = after, path, reach * 2
    done, done_path = materialise(ids.join(needs, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0).cast("long")), "chat-levels")
    hops = jumps.select("conv_id", F.col("call_id").alias("need"), "to", "steps", "open")
    edges, edges_path = materialise(
        refs.join(needs.filter("n > 1"), ["conv_id", "call_id"], "left_semi").join(hops, ["conv_id", "need"], "left")
        .select("conv_id", "call_id", F.when(F.col("open").isNull(), F.col("need")).when(~F.col("open"), F.col("to")).alias("to"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")), "chat-edges")
    grown = not edges.isEmpty()
    while grown:
        ready = (edges.join(done.withColumnRenamed("call_id", "to"), ["conv_id", "to"], "left")
                 .groupBy("conv_id", "call_id").agg(F.max(F.col("level") + F.col("steps")).alias("high"), F.count_if(F.col("level").isNull()).alias("open"))
                 .filter("open = 0").select("conv_id", "call_id", F.col("high").alias("level")).join(done, ["conv_id", "call_id"], "left_anti"))
        more, path = materialise(done.unionByName(ready), "chat-levels")
        grown = more.count() > done.count()
        discard(spark, done_path)
        done, done_path = more, path
    arrived = jumps.filter("not open").join(done.withColumnRenamed("call_id", "to"), ["conv_id", "to"]).select("conv_id", "call_id", (F.col("level") + F.col("steps")).alias("level"))
    return ids.join(done.unionByName(arrived).withColumn("level", F.col("level").cast("int")), ["conv_id", "call_id"], "left")


def canonical(**fields):
    """Canonical JSON of named columns of JSON text: keys sorted; a null column is null."""
    parts = []
    for name in sorted(fields):
        parts += [F.lit(("," if parts else "{") + f'"{name}":'), F.coalesce(fields[name], F.lit("null"))]
    return F.concat(*parts, F.lit("}"))


def text_json(col):
    """A text as a JSON string."""
    return F.when(col.isNull(), F.lit(None)).otherwise(F.regexp_replace(F.to_json(F.struct(col.alias("v"))), r'^\{"v":|\}$', ""))


def value_json(text):
    """JSON text with sorted keys; text that is no JSON becomes a JSON string."""
    return F.when(F.try_parse_json(text).isNotNull(), F.to_json(F.try_parse_json(text))).otherwise(text_json(text))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row a call or orphan result: (conv_id, call_id, turn, kind, level, linked, complaint, json).

    calls: (conv_id, turn, pos, call_id, name, arguments as JSON text); results: (conv_id, turn,
    call_id, content as JSON text); schemas: see SCHEMA_COLUMNS. Of calls or results that repeat an
    id within a conversation the earliest counts (ties: the smaller text), so no pair is listed
    twice. Rows without an id are dropped from linking and come out as kind `call` or `result`
    with linked false. (level, turn, call_id) orders a conversation; no conversation is ever
    gathered in one place.
    """
    first = lambda df, *cols: df.filter("call_id is not null and conv_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct(*cols)).alias("x")).select("conv_id", "call_id", "x.*")
    own = first(calls, "turn", "pos", "name", "arguments")
    answers = first(results, "turn", "content").select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content", F.lit(True).alias("answered"))
    ordered = own.join(levels(own), ["conv_id", "call_id"])
    joined = (ordered.withColumn("called", F.lit(True)).join(answers.hint("shuffle_hash"), ["conv_id", "call_id"], "full").join(schemas, "name", "left"))
    loose = calls.filter("call_id is null or conv_id is null").select("conv_id", "call_id", "turn", F.lit("call").alias("kind"), F.col("name").alias("n"), F.col("arguments").alias("body")).unionByName(
        results.filter("call_id is null or conv_id is null").select("conv_id", "call_id", "turn", F.lit("result").alias("kind"), F.lit(None).cast("string").alias("n"), F.col("content").alias("body")))
    called, answered = F.coalesce("called", F.lit(False)), F.coalesce("answered", F.lit(False))
    linked = joined.select(
        "conv_id", "call_id", F.coalesce("turn", "result_turn").alias("turn"), F.when(called, F.lit("call")).otherwise(F.lit("result")).alias("kind"), "level",
        (called & answered).alias("linked"), F.when(called, validity(F.col("arguments"), F.col("params"))).otherwise(F.lit("no call")).alias("complaint"),
        canonical(arguments=value_json(F.col("arguments")), id=text_json(F.col("call_id")), name=text_json(F.col("name")), result=value_json(F.col("content"))).alias("json"))
    none = F.lit(None).cast("string")
    return linked.unionByName(loose.select(
        "conv_id", "call_id", "turn", "kind", F.lit(None).cast("int").alias("level"), F.lit(False).alias("linked"), F.lit("no id").alias("complaint"),
        canonical(arguments=F.when(F.col("kind") == "call", value_json(F.col("body"))), id=none, name=text_json(F.col("n")), result=F.when(F.col("kind") == "result", value_json(F.col("body")))).alias("json")))


def format_chat(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """Linked calls of a conversation table, and its plain messages as canonical JSON of kind `message`."""
    calls, results, plain = extract_calls(messages)
    said = plain.select("conv_id", F.lit(None).cast("string").alias("call_id"), "turn", F.lit("message").alias("kind"), F.lit(None).cast("int").alias("level"), F.lit(False).alias("linked"), F.lit("").alias("complaint"),
                        canonical(content=text_json(F.col("text")), role=text_json(F.col("role"))).alias("json"))
    return link_calls(calls, results, schemas).unionByName(said)
