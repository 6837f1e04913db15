"""E10 ``parse_agent_response``: agent JSON -> typed log columns, as one native
expression tree (``from_json`` + higher-order functions + regex).

General variant: the first ``text`` item gives the reply; the first
``tool_result`` item gives the search hits (ids, scores, snippets); a fenced
```json block (else a raw brace match containing "response") gives
category / priority / summary / escalation fields; the reply shown to the
user is the part after the last fence with leading dashes and spaces
removed. Invalid JSON anywhere the reference lets an exception escape gives
the error row (category ERROR, priority HIGH, escalate to IT_SUPPORT).

The queue variants (it, hr, finance) keep a fixed category and MEDIUM, and
use the first 100 characters of the user's message as summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketflow.functions.text import JS_SPACE, js_trim

AGENT_SCHEMA = (
    "content array<struct<type: string, text: string, tool_result: struct<content: array<struct<"
    "json: struct<search_results: array<struct<id: string, kb_id: string, `@CONFIDENCE_SCORE`: string, "
    "columns: map<string, string>, text: string, question: string>>>>>>>>, "
    "metadata struct<usage: struct<tokens_consumed: array<struct<input_tokens: struct<total: long>, "
    "output_tokens: struct<total: long>, model_name: string>>>>"
)
PARSED_SCHEMA = ("summary string, category string, priority string, needs_escalation boolean, "
                 "needsEscalation boolean, escalation_team string, escalationTeam string, "
                 "resolution_steps array<string>, resolutionSteps array<string>")

FENCE = "```"
FENCED_JSON = r"```json" + JS_SPACE + r"*([\s\S]*?)```"
RAW_WITH_TEAM = r'\{[\s\S]*"escalation_team"[\s\S]*?\}'
RAW_WITH_RESPONSE = r'\{[\s\S]*"response"[\s\S]*?\}'
FLOAT_PREFIX = JS_SPACE[:-1] + r"]*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)"

# Defaults and error texts of the reference parsers.
DEFAULT_SUMMARY = "問い合わせ内容"
DEFAULT_CATEGORY = "OTHER"
DEFAULT_PRIORITY = "MEDIUM"
ERROR_SUMMARY = "エラーが発生しました"
ERROR_REPLY = "申し訳ありません。処理中にエラーが発生しました。担当者に連絡いたします。"
ERROR_TEAM = "IT_SUPPORT"
VARIANT_CATEGORY = {"it": "IT", "hr": "HR", "finance": "FINANCE"}
VARIANT_ERROR_SUMMARY = "Error"
VARIANT_ERROR_REPLY = "エラーが発生しました。担当者に連絡します。"
SNIPPET = 100


def _truthy(c: Column) -> Column:
    return F.when(c.isNotNull() & (c != ""), c)


def _bad_json(c: Column) -> Column:
    v = F.try_parse_json(c)
    return v.isNull() | F.is_variant_null(v)


def _parse_float(c: Column) -> Column:
    """JS parseFloat: the leading decimal number, NULL (NaN) when none."""
    return F.nullif(F.regexp_extract(c, "^" + FLOAT_PREFIX, 1), F.lit("")).try_cast("double")


def _reply_after_fence(content: Column) -> Column:
    tail = js_trim(F.substring_index(content, FENCE, -1))
    return F.regexp_replace(tail, "^[-" + JS_SPACE[1:-1] + "]+", "")


def parse_agent_response(df: DataFrame, response: str = "response", message: str | None = None,
                         variant: str = "general") -> DataFrame:
    """Add the parsed columns to ``df`` (see module doc for the rules).

    The work is staged in successive projections (raw JSON -> parsed
    struct -> text content -> fenced block -> fields) so each expensive
    step (``from_json``, regex scans) runs once per row: Catalyst does not
    collapse projections that would duplicate a non-trivial expression.
    """
    base = df.columns
    x = df.withColumn("_resp", F.coalesce(_truthy(F.col(response)), F.lit("{}")))
    x = x.withColumn("_agent", F.from_json("_resp", AGENT_SCHEMA)).withColumn("_error", _bad_json(F.col("_resp")))
    x = x.withColumn("_items", F.coalesce(F.col("_agent.content"), F.array()))
    text_item = F.try_element_at(F.filter("_items", lambda i: i["type"] == "text"), F.lit(1))
    x = x.withColumn("_content", F.coalesce(_truthy(text_item["text"]), F.lit("")))
    x = x.withColumn("_fenced", F.col("_content").rlike(FENCED_JSON)) \
         .withColumn("_reply_fenced", _reply_after_fence(F.col("_content")))
    reply = F.when(F.col("_fenced"), F.coalesce(_truthy(F.col("_reply_fenced")), F.col("_content"))) \
             .otherwise(F.col("_content"))
    tmp = ["_resp", "_agent", "_error", "_items", "_content", "_fenced", "_reply_fenced"]

    if variant != "general":
        msg = F.coalesce(F.col(message), F.lit("")) if message is not None else F.lit("")
        err = F.col("_error")
        out = x.select(
            *base,
            F.lit(VARIANT_CATEGORY.get(variant, variant.upper())).alias("category"),
            F.lit(DEFAULT_PRIORITY).alias("priority"),
            F.when(err, F.lit(VARIANT_ERROR_SUMMARY)).otherwise(F.substring(msg, 1, SNIPPET)).alias("summary"),
            F.when(err, F.lit(VARIANT_ERROR_REPLY)).otherwise(reply).alias("ai_response_text"),
            err.alias("parse_error"))
        return out

    x = (x.withColumn("_block", F.regexp_extract("_content", FENCED_JSON, 1))
          .withColumn("_raw_team", F.regexp_extract("_content", RAW_WITH_TEAM, 0))
          .withColumn("_raw_resp", F.regexp_extract("_content", RAW_WITH_RESPONSE, 0)))
    x = x.withColumn("_block_bad", _bad_json(F.col("_block")))
    raw_team = F.col("_raw_team")
    fenced_src = F.when(~F.col("_block_bad"), F.col("_block")).when(raw_team != "", raw_team)
    src = F.when(F.col("_fenced"), fenced_src).otherwise(F.when(F.col("_raw_resp") != "", F.col("_raw_resp")))
    inner_error = F.col("_fenced") & F.col("_block_bad") & (raw_team != "") & _bad_json(raw_team)
    x = x.withColumn("_parsed", F.from_json(src, PARSED_SCHEMA)).withColumn("_err", F.col("_error") | inner_error)

    tool = F.try_element_at(F.filter("_items", lambda i: i["type"] == "tool_result"), F.lit(1))
    x = x.withColumn("_hits", F.coalesce(
        F.try_element_at(F.coalesce(tool["tool_result"]["content"], F.array()), F.lit(1))["json"]["search_results"],
        F.array()))
    x = x.withColumn("_usage", F.try_element_at(
        F.coalesce(F.col("_agent.metadata.usage.tokens_consumed"), F.array()), F.lit(1)))
    hit_id = lambda r: F.coalesce(_truthy(r["id"]), _truthy(r["kb_id"]))
    ids = F.array_join(F.filter(F.transform("_hits", hit_id), lambda v: v.isNotNull()), ",")
    scores = F.transform("_hits", lambda r: F.struct(
        hit_id(r).alias("id"),
        _parse_float(F.coalesce(_truthy(r["@CONFIDENCE_SCORE"]),
                                _truthy(F.try_element_at(r["columns"], F.lit("@CONFIDENCE_SCORE"))),
                                F.lit("0"))).alias("score"),
        F.substring(F.coalesce(_truthy(r["text"]), _truthy(r["question"]), F.lit("")), 1, SNIPPET).alias("text")))
    p = F.col("_parsed")
    steps = F.coalesce(p["resolution_steps"], p["resolutionSteps"], F.array().cast("array<string>"))
    needs = F.coalesce(p["needs_escalation"], F.lit(False)) | F.coalesce(p["needsEscalation"], F.lit(False))
    u = F.col("_usage")
    err = F.col("_err")

    def ok(c, e):
        return F.when(err, e).otherwise(c)

    return x.select(
        *base,
        ok(F.coalesce(_truthy(p["category"]), F.lit(DEFAULT_CATEGORY)), F.lit("ERROR")).alias("category"),
        ok(F.coalesce(_truthy(p["priority"]), F.lit(DEFAULT_PRIORITY)), F.lit("HIGH")).alias("priority"),
        ok(F.coalesce(_truthy(p["summary"]), F.lit(DEFAULT_SUMMARY)), F.lit(ERROR_SUMMARY)).alias("summary"),
        ok(reply, F.lit(ERROR_REPLY)).alias("ai_response_text"),
        ok(needs, F.lit(True)).alias("needs_escalation"),
        ok(F.coalesce(_truthy(p["escalation_team"]), _truthy(p["escalationTeam"])), F.lit(ERROR_TEAM))
         .alias("escalation_team"),
        ok(steps, F.array().cast("array<string>")).alias("resolution_steps"),
        ok(ids, F.lit("")).alias("matched_kb_ids"),
        ok(scores, F.array().cast(scores_type())).alias("confidence_scores"),
        ok(F.coalesce(u["input_tokens"]["total"], F.lit(0)), F.lit(0)).cast("int").alias("tokens_input"),
        ok(F.coalesce(u["output_tokens"]["total"], F.lit(0)), F.lit(0)).cast("int").alias("tokens_output"),
        ok(F.coalesce(_truthy(u["model_name"]), F.lit("unknown")), F.lit("unknown")).alias("model_name"),
        err.alias("parse_error"))


def scores_type() -> str:
    return "array<struct<id: string, score: double, text: string>>"
