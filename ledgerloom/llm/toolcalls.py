"""Chat formatting by tool-call linking, in DataFrame functions only.

Calls and results meet by a hash join on (conversation, identifier); calls and results that share an identifier are
combined before the join, so a repeated identifier makes no pairs. The topological level of a call is its number of
ancestors, found by pointer doubling. Arguments are validated against a schema by name, and each linked call is
serialised as canonical JSON: sorted keys, no blanks.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

#: name -> parameter -> (JSON type, required)
SCHEMAS = {
    "answer": {"chars": ("integer", True), "prompt": ("string", True), "turn": ("integer", True)},
    "configure": {"chars": ("integer", True), "prompt": ("string", True), "turn": ("integer", True)},
}
_TYPES = {
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DOUBLE", "DECIMAL"),
    "string": ("STRING",),
    "boolean": ("BOOLEAN",),
    "object": ("OBJECT",),
    "array": ("ARRAY",),
}


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, parent_id) -> (conv_id, call_id, depth); null depth where the ancestry is a cycle.

    A parent that is no call of the conversation counts as none.
    """
    known = calls.select("conv_id", F.col("call_id").alias("parent_id"), F.lit(True).alias("known"))
    state = settle(
        calls.join(known, ["conv_id", "parent_id"], "left").select(
            "conv_id", "call_id", F.when(F.col("known"), F.col("parent_id")).alias("up"),
            F.when(F.col("known"), 1).otherwise(0).cast("long").alias("depth"),
        ),
        "levels",
    )
    for _ in range(ceil(log2(state.count() + 2)) + 1):
        if not state.where("up IS NOT NULL").limit(1).count():
            break
        above = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("higher"), F.col("depth").alias("more"))
        climbed = state.where("up IS NOT NULL").join(above, ["conv_id", "up"]).select(
            "conv_id", "call_id", F.col("higher").alias("up"), (F.col("depth") + F.col("more")).alias("depth")
        )
        state = settle(state.where("up IS NULL").unionByName(climbed), "levels")
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def violations(name: Column, arguments: Column, schemas: dict = SCHEMAS) -> Column:
    """Sorted, comma-joined faults of the arguments: a parameter that is missing, of a wrong type or unknown."""
    parsed = F.try_parse_json(arguments)
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    out = F.when(name.isNull() | ~name.isin(*schemas), F.lit("unknown tool"))
    out = out.when(parsed.isNull() | ~F.startswith(F.trim(arguments), F.lit("{")), F.lit("not an object"))
    for tool, parameters in schemas.items():
        faults = [F.transform(F.array_except(keys, F.array(*map(F.lit, sorted(parameters)))), lambda k: F.concat(k, F.lit(" unknown")))]
        for parameter, (kind, required) in sorted(parameters.items()):
            there = F.schema_of_variant(F.variant_get(parsed, f"$.{parameter}", "variant"))
            right = F.regexp_extract(F.coalesce(there, F.lit("")), "^[A-Z]+", 0).isin(*_TYPES[kind])
            fault = F.when(~F.array_contains(keys, parameter), F.lit(f"{parameter} missing") if required else F.lit(None))
            faults.append(F.array(fault.when(~right, F.lit(f"{parameter} not {kind}")).cast("string")))
        out = out.when(name == tool, F.array_join(F.array_sort(F.array_compact(F.concat(*faults))), ","))
    return out


def link(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """calls (conv_id, call_id, parent_id, turn, name, arguments), results (conv_id, call_id, turn, content) ->
    one row per identifier of a conversation.

    Of calls (results) that share an identifier the earliest by turn, then text, stands; their number is returned.
    status: ``linked``, ``no_result``, ``orphan_result``, ``early_result`` (before its call) or ``cycle``. Rows with
    a null conv_id or call_id can be linked to nothing and are left out. Null names, arguments and contents are null in
    the record. Texts are serialised whole, whatever their length. Other columns are ignored, whatever their names.
    Empty tables give empty results.
    """
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = lambda *by: F.min(F.struct(*by))
    asked = (
        calls.where(named).groupBy("conv_id", "call_id")
        .agg(first("turn", "name", "arguments", "parent_id").alias("c"), F.count("*").alias("n_calls"))
        .select("conv_id", "call_id", "c.*", "n_calls")
    )
    asked = settle(asked, "calls")
    given = (
        results.where(named).groupBy("conv_id", "call_id")
        .agg(first("turn", "content").alias("r"), F.count("*").alias("n_results"))
        .select("conv_id", "call_id", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), "n_results")
    )
    linked = (
        asked.join(levels(asked.select("conv_id", "call_id", "parent_id")), ["conv_id", "call_id"])
        .hint("shuffle_hash")
        .join(given, ["conv_id", "call_id"], "full")
    )
    status = (
        F.when(F.col("n_calls").isNull(), "orphan_result")
        .when(F.col("depth").isNull(), "cycle")
        .when(F.col("n_results").isNull(), "no_result")
        .when(F.col("result_turn") < F.col("turn"), "early_result")
        .otherwise("linked")
    )
    # a variant object keeps its keys sorted, so its JSON is canonical
    arguments = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.lit("null"))
    text = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1), F.lit(""))
    quoted = lambda c: F.when(F.col(c).isNull(), "null").otherwise(text(c))
    record = F.concat(
        F.lit('{"arguments":'), arguments, F.lit(',"id":'), quoted("call_id"), F.lit(',"name":'), quoted("name"),
        F.lit(',"result":'), quoted("content"), F.lit("}"),
    )
    return linked.select(
        "conv_id", "call_id", "turn", "result_turn", F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"), "depth", status.alias("status"),
        F.when(F.col("n_calls").isNotNull(), violations(F.col("name"), F.col("arguments"), schemas)).alias("violations"),
        record.alias("record"),
    )


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a chat table: a user turn asks the tool ``answer``, a system turn ``configure``; an
    assistant turn is the result for the turn before it. A user turn depends on the one two turns earlier. Turns of any
    other role, or of none, call nothing and answer nothing: they give no row. Turns without a conversation or number
    can't be identified; ``link`` leaves them out."""
    ident = lambda at: F.concat(F.col("conv_id"), F.lit("-"), at)
    arguments = F.to_json(
        F.struct(F.char_length("text").alias("chars"), F.col("text").alias("prompt"), F.col("turn").alias("turn")),
        {"ignoreNullFields": "false"},
    )
    calls = turns.where("role IN ('user', 'system')").select(
        "conv_id", ident(F.col("turn")).alias("call_id"), ident(F.col("turn") - 2).alias("parent_id"), "turn",
        F.when(F.col("role") == "user", "answer").otherwise("configure").alias("name"), arguments.alias("arguments"),
    )
    results = turns.where("role = 'assistant'").select(
        "conv_id", ident(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content")
    )
    return calls, results


def op10_chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link(*from_conversations(table(spark, sf_dir, "conversations")))
    return linked.select(
        "conv_id", "call_id", F.col("turn").cast("long"), F.col("result_turn").cast("long"), "n_calls", "n_results",
        "depth", "status", "violations", F.sha2("record", 256).alias("record_sha256"),
    )


OP10_SQL = """
WITH RECURSIVE turns AS (
  SELECT * FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
calls AS (
  SELECT conv_id, conv_id || '-' || turn AS call_id, conv_id || '-' || (turn - 2) AS parent_id,
    any_value(turn) AS turn, min((CASE role WHEN 'user' THEN 'answer' ELSE 'configure' END, text)) AS one,
    count(*) AS n_calls
  FROM turns WHERE role IN ('user', 'system') GROUP BY 1, 2, 3),
results AS (
  SELECT conv_id, conv_id || '-' || (turn - 1) AS call_id, any_value(turn) AS result_turn, min(text) AS content,
    count(*) AS n_results
  FROM turns WHERE role = 'assistant' GROUP BY 1, 2),
levels AS (
  SELECT conv_id, call_id, CAST(0 AS BIGINT) AS depth FROM calls
  WHERE (conv_id, parent_id) NOT IN (SELECT (conv_id, call_id) FROM calls)
  UNION ALL
  SELECT c.conv_id, c.call_id, l.depth + 1 FROM calls c JOIN levels l
    ON c.conv_id = l.conv_id AND c.parent_id = l.call_id),
named AS (SELECT *, one[1] AS name, one[2] AS text FROM calls JOIN levels USING (conv_id, call_id))
SELECT conv_id, call_id, turn, result_turn, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
  depth,
  CASE WHEN n_calls IS NULL THEN 'orphan_result' WHEN n_results IS NULL THEN 'no_result' ELSE 'linked' END AS status,
  CASE WHEN n_calls IS NULL THEN NULL WHEN text IS NULL THEN 'chars not integer,prompt not string' ELSE '' END
    AS violations,
  sha256('{"arguments":' || CASE WHEN n_calls IS NULL THEN 'null' ELSE '{"chars":' ||
    coalesce(CAST(length(text) AS VARCHAR), 'null') || ',"prompt":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null')
    || ',"turn":' || turn || '}' END || ',"id":"' || call_id || '","name":' ||
    coalesce('"' || name || '"', 'null') || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}')
    AS record_sha256
FROM named FULL JOIN results USING (conv_id, call_id)
"""
