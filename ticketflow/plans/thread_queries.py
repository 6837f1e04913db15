"""Registered thread and conversation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketflow.operators import threads
from ticketflow.plans.registry import register, round_doubles
from ticketflow.sources import adapters as A

_KEYED = """k AS (SELECT *, CASE WHEN thread_ts IS NOT NULL AND thread_ts <> '' THEN thread_ts
                       ELSE 'no-thread-' || CAST(id AS VARCHAR) END AS thread_key FROM {src})"""

_SUMMARY = """
a AS (SELECT thread_key,
    arg_min_null(message, (created_at, id)) FILTER (WHERE log_type = 'INQUIRY') AS _inq,
    arg_min_null(message, (created_at, id)) AS _first,
    min(created_at) AS created_at,
    count(*) FILTER (WHERE log_type = 'EVALUATION') AS _evals,
    arg_min_null(evaluation, (created_at, id)) FILTER (WHERE log_type = 'EVALUATION') AS _eval,
    arg_max_null(status, (created_at, id)) AS status,
    count(*) AS log_count
  FROM k GROUP BY thread_key),
s AS (SELECT thread_key, coalesce(nullif(_inq, ''), nullif(_first, ''), '-') AS first_message, created_at,
         _evals > 0 AS has_evaluation, nullif(_eval, '') AS evaluation_result, status, log_count FROM a)"""


@register("thread_summary", "WITH " + _KEYED.format(src="logs") + "," + _SUMMARY + "\nSELECT * FROM s",
          ("logs",))
def q_thread_summary(spark, d):
    """A14 per-thread summary of the log table."""
    return threads.thread_summary(A.logs(spark, d))


@register("thread_stats", "WITH " + _KEYED.format(src="logs") + "," + _SUMMARY + """
SELECT count(*) AS threads,
       count(*) FILTER (WHERE evaluation_result IN ('helpful', 'resolved')) AS resolved,
       count(*) FILTER (WHERE evaluation_result = 'escalate') AS escalated,
       count(*) FILTER (WHERE NOT has_evaluation) AS pending
FROM s""", ("logs",))
def q_thread_stats(spark, d):
    """A15 thread counters over A14."""
    return threads.thread_stats(threads.thread_summary(A.logs(spark, d)))


@register("conversation_thread_summary",
          "WITH " + _KEYED.format(src="conversation").replace("SELECT *,", "SELECT *, CAST(NULL AS VARCHAR) AS evaluation,")
          + "," + _SUMMARY + "\nSELECT * FROM s", ("conversation",))
def q_conversation_thread_summary(spark, d):
    """A14 over conversation threads (no evaluations: all pending)."""
    return threads.thread_summary(A.conversation(spark, d).withColumn("evaluation", F.lit(None).cast("string")))


@register("conversation_window", """
SELECT id, thread_ts, log_type, position FROM (
  SELECT id, thread_ts, log_type,
         row_number() OVER (PARTITION BY thread_ts ORDER BY created_at, id) AS position
  FROM logs WHERE thread_ts IS NOT NULL AND thread_ts <> '' AND log_type IN ('INQUIRY', 'AI_RESPONSE'))
WHERE position <= 20""", ("logs",))
def q_conversation_window(spark, d):
    """W2 first 20 conversation rows per log thread (F7 filter first)."""
    return threads.conversation_window(A.logs(spark, d), 20).select(
        "id", "thread_ts", "log_type", F.col("position").cast("long").alias("position"))


@register("conversation_window_newest", """
SELECT id, thread_ts, log_type, position FROM (
  SELECT id, thread_ts, log_type,
         row_number() OVER (PARTITION BY thread_ts ORDER BY created_at DESC, id DESC) AS position
  FROM conversation WHERE thread_ts IS NOT NULL AND thread_ts <> '' AND log_type IN ('INQUIRY', 'AI_RESPONSE'))
WHERE position <= 3""", ("conversation",))
def q_conversation_window_newest(spark, d):
    """W2 with newest=True and depth 3 over conversations."""
    return threads.conversation_window(A.conversation(spark, d), 3, newest=True).select(
        "id", "thread_ts", "log_type", F.col("position").cast("long").alias("position"))


@register("turn_numbers", """
SELECT id, thread_ts,
       CAST(row_number() OVER (PARTITION BY thread_ts ORDER BY created_at, id) AS INTEGER) AS turn_number,
       count(*) OVER (PARTITION BY thread_ts) > 1 AS is_multi_turn
FROM conversation WHERE thread_ts IS NOT NULL AND thread_ts <> '' AND log_type IN ('INQUIRY', 'AI_RESPONSE')""",
          ("conversation",))
def q_turn_numbers(spark, d):
    """W3 turn number and multi-turn flag (skew-safe sequence)."""
    return threads.turn_numbers(A.conversation(spark, d)).select("id", "thread_ts", "turn_number", "is_multi_turn")


@register("turn_numbers_logs", """
SELECT id, thread_ts,
       CAST(row_number() OVER (PARTITION BY thread_ts ORDER BY created_at, id) AS INTEGER) AS turn_number,
       count(*) OVER (PARTITION BY thread_ts) > 1 AS is_multi_turn
FROM logs WHERE thread_ts IS NOT NULL AND thread_ts <> '' AND log_type IN ('INQUIRY', 'AI_RESPONSE')""",
          ("logs",))
def q_turn_numbers_logs(spark, d):
    """W3 over the log table's user-day threads."""
    return threads.turn_numbers(A.logs(spark, d)).select("id", "thread_ts", "turn_number", "is_multi_turn")


@register("first_last_in_thread", "WITH " + _KEYED.format(src="logs") + """,
f AS (SELECT thread_key,
        arg_min_null(message, (created_at, id)) FILTER (WHERE log_type = 'INQUIRY') AS first_inquiry_message,
        arg_max_null(status, (created_at, id)) AS latest_status
      FROM k GROUP BY thread_key)
SELECT k.id, k.thread_key, f.first_inquiry_message, f.latest_status FROM k JOIN f USING (thread_key)""",
          ("logs",))
def q_first_last_in_thread(spark, d):
    """W4 first inquiry message and latest status attached to every row."""
    return threads.first_last_in_thread(A.logs(spark, d)).select(
        "id", "thread_key", "first_inquiry_message", "latest_status")


@register("build_messages", """
WITH w AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY thread_ts ORDER BY created_at, id) AS position
    FROM conversation WHERE thread_ts IS NOT NULL AND thread_ts <> '' AND log_type IN ('INQUIRY', 'AI_RESPONSE'))
  WHERE position <= 20),
m AS (
  SELECT thread_ts, position,
         CASE WHEN log_type = 'INQUIRY' THEN 'user' ELSE 'assistant' END AS role,
         CASE WHEN log_type = 'INQUIRY' THEN message ELSE ai_response_text END AS text
  FROM w WHERE log_type = 'INQUIRY' OR (ai_response_text IS NOT NULL AND ai_response_text <> ''))
SELECT thread_ts, count(*) AS message_count,
       to_json(list({'role': role, 'content': [{'type': 'text', 'text': text}]} ORDER BY position))
         ::VARCHAR AS messages_json
FROM m GROUP BY thread_ts""", ("conversation",))
def q_build_messages(spark, d):
    """W2 + E9: agent message array per conversation thread as JSON."""
    out = threads.build_messages(threads.conversation_window(A.conversation(spark, d), 20))
    return out.select("thread_ts", F.col("message_count").cast("long").alias("message_count"), "messages_json")


@register("reply_chain", """
WITH i AS (SELECT id AS inquiry_id, created_at AS inq_at, thread_ts, category FROM logs WHERE log_type = 'INQUIRY'),
r AS (SELECT id AS response_id, inquiry_id AS r_inq, created_at AS resp_at FROM logs WHERE log_type = 'AI_RESPONSE'),
e AS (SELECT id AS evaluation_id, inquiry_id AS e_resp, evaluation FROM logs WHERE log_type = 'EVALUATION')
SELECT inquiry_id, response_id, evaluation_id, thread_ts, category,
       epoch_us(resp_at) // 1000 - epoch_us(inq_at) // 1000 AS response_ms, evaluation,
       CASE WHEN evaluation_id IS NULL THEN 'pending' WHEN evaluation IN ('resolved', 'helpful') THEN 'resolved'
            WHEN evaluation = 'escalate' THEN 'escalated' WHEN evaluation = 'direct_ticket' THEN 'human'
            ELSE evaluation END AS outcome
FROM i JOIN r ON inquiry_id = r_inq LEFT JOIN e ON response_id = e_resp""", ("logs",))
def q_reply_chain(spark, d):
    """J8 inquiry -> response -> evaluation chain with latency and outcome."""
    return threads.reply_chain(A.logs(spark, d))


@register("ticket_comments", """
SELECT thread_ts AS ticket_id, id, role_author AS author, content, created_at,
       row_number() OVER (PARTITION BY thread_ts ORDER BY created_at, id) AS ordinal
FROM (SELECT thread_ts, id, log_type AS role_author, coalesce(message, ai_response_text) AS content, created_at
      FROM conversation)""", ("conversation",))
def q_ticket_comments(spark, d):
    """J2 comments per ticket ascending (conversation turns as comments)."""
    conv = A.conversation(spark, d)
    comments = conv.select(F.col("thread_ts").alias("ticket_id"), "id", F.col("log_type").alias("author"),
                           F.coalesce("message", "ai_response_text").alias("content"), "created_at")
    parents = conv.select(F.col("thread_ts").alias("ticket_id"))
    return threads.children_of(parents, comments, "ticket_id", ["created_at", "id"]).select(
        "ticket_id", "id", "author", "content", "created_at", F.col("ordinal").cast("long").alias("ordinal"))
