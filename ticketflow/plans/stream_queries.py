"""Registered streaming queries (T1, T2, T5-T8), each run as a bounded
``availableNow`` catch-up over a file stream of the given tables; the result
table is read back. Batch equality is the oracle where SQL can state it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketflow.plans.registry import register, round_doubles
from ticketflow.plans.text_queries import _TRIM, _sql_skip
from ticketflow.sources import adapters as A
from ticketflow.streaming import jobs, sinks, upkeep


@register("kpi_stream_daily", """
SELECT date_trunc('day', created_at) AS window_start,
  count(*) FILTER (WHERE log_type = 'INQUIRY') AS total_inquiries,
  count(*) FILTER (WHERE log_type = 'AI_RESPONSE') AS ai_responses,
  count(*) FILTER (WHERE status = 'RESOLVED') AS resolved,
  count(*) FILTER (WHERE status = 'ESCALATED') AS escalated,
  CAST(round(CAST(count(*) FILTER (WHERE status = 'RESOLVED') AS DECIMAL(38, 10)) * 100
        / NULLIF(count(*) FILTER (WHERE log_type = 'INQUIRY'), 0), 2) AS DOUBLE) AS resolution_rate,
  round(avg(tokens_input + tokens_output) FILTER (WHERE log_type = 'AI_RESPONSE'), 6) AS avg_tokens
FROM logs GROUP BY 1""", ("logs",))
def q_kpi_stream_daily(spark, d):
    """T5: daily KPI windows from the events file stream (watermark 1 day, update mode, upsert sink)."""
    base = jobs.scratch(spark, "kpi")
    jobs.kpi_stream(spark, A.logs_of(A.events_stream(spark, d)), base)
    return round_doubles(jobs.kpi_finish(sinks.read_current(spark, base)))


_SESSIONS_SQL = """
WITH l AS (SELECT user_id, created_at, log_type,
                  lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at, id) AS prev FROM logs),
m AS (SELECT *, sum(CASE WHEN prev IS NULL OR created_at >= prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
                 OVER (PARTITION BY user_id ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS sid FROM l)
SELECT user_id, min(created_at) AS session_start, max(created_at) + INTERVAL 30 MINUTE AS session_end,
       count(*) AS events, count(*) FILTER (WHERE log_type = 'INQUIRY') AS inquiries
FROM m GROUP BY user_id, sid"""


@register("conversation_sessions", _SESSIONS_SQL, ("logs",))
def q_conversation_sessions(spark, d):
    """T6 (batch form): per-user activity sessions with a 30 minute gap (session_window)."""
    return jobs.conversation_sessions(A.logs(spark, d), "30 minutes")


@register("conversation_sessions_stream", _SESSIONS_SQL, ("logs",))
def q_conversation_sessions_stream(spark, d):
    """T6 (streaming form): sessions that the stream closed, and those still open at the end of the catch-up."""
    base = jobs.scratch(spark, "sessions")
    jobs.session_stream(spark, A.logs_of(A.events_stream(spark, d)), base)
    return jobs.closed_sessions(spark, base).unionByName(jobs.open_sessions(spark, base))


@register("urgent_alerts", """
SELECT ticket_id,
  CASE WHEN source_channel IS NOT NULL AND source_channel <> '' AND source_channel NOT IN ('slack', 'web', 'email')
       THEN source_channel ELSE 'C-URGENT' END AS channel,
  '緊急チケット: ' || ticket_id || ' ' || coalesce(summary, '') AS text, created_at
FROM tickets WHERE urgency = 'HIGH' AND status IN ('OPEN', 'IN_PROGRESS', 'HUMAN_REQUESTED')""", ("tickets",))
def q_urgent_alerts(spark, d):
    """T8 outbox of HIGH-urgency active tickets with the channel to notify."""
    return jobs.urgent_alerts(A.tickets(spark, d), "C-URGENT")


def _inbound_messages(spark, d):
    """Inbound chat events in the webhook schema, one per conversation turn.

    Every 4th conversation's turn 1 is delivered twice (a redelivery with the
    same event id); DMs for every 5th conversation; first turns have no
    thread (dropped unless a DM); every 3rd turn carries a mention.
    """
    cv = A.read(spark, d, "conversations")
    eid = (F.col("conv_id") * 1000 + F.col("turn")).cast("string")
    rows = cv.select(
        eid.alias("event_id"), F.lit("message").alias("type"), F.lit(None).cast("string").alias("subtype"),
        F.when(F.col("role") == "system", F.lit("B0")).alias("bot_id"),
        F.concat(F.lit("C"), (F.col("conv_id") % 7).cast("string")).alias("channel_id"),
        F.when(F.col("conv_id") % 5 == 0, "im").otherwise("channel").alias("channel_type"),
        F.when(F.col("turn") > 0, F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))).alias("thread_ts"),
        eid.alias("ts"), F.concat(F.lit("U"), F.col("conv_id").cast("string")).alias("user_id"),
        F.lit(None).cast("string").alias("user_name"),
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<@U0ABC12> "), F.col("text"))).otherwise(F.col("text"))
         .alias("message"),
        (F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60).cast("string").alias("event_ts"),
        F.lit("it").alias("category"), F.lit(None).cast("string").alias("category_label"),
        F.lit("slack").alias("source"), F.lit(None).cast("int").alias("retry_num"),
        F.lit(None).cast("string").alias("_corrupt_record"))
    again = rows.where((F.col("event_id").cast("long") % 4000 == 1))
    return rows.unionByName(again)


_INTAKE_SQL = f"""
WITH ev AS (
  SELECT DISTINCT CAST(conv_id * 1000 + turn AS VARCHAR) AS event_id, conv_id, turn, role,
    'C' || CAST(conv_id % 7 AS VARCHAR) AS channel_id,
    CASE WHEN conv_id % 5 = 0 THEN 'im' ELSE 'channel' END AS channel_type,
    CASE WHEN turn > 0 THEN 'conv-' || CAST(conv_id AS VARCHAR) END AS thread_ts,
    CAST(conv_id * 1000 + turn AS VARCHAR) AS ts, 'U' || CAST(conv_id AS VARCHAR) AS user_id,
    CASE WHEN turn % 3 = 0 THEN '<@U0ABC12> ' || text ELSE text END AS raw,
    1704067200 + conv_id * 3600 + turn * 60 AS es
  FROM conversations),
r AS (SELECT *, CASE WHEN role = 'system' THEN 'drop' WHEN channel_type = 'im' THEN 'selection'
                     WHEN thread_ts IS NOT NULL AND thread_ts <> ts THEN 'process' ELSE 'drop' END AS route,
             {_TRIM.format(x="regexp_replace(coalesce(raw, ''), '<@[A-Z0-9]+>', '', 'g')")} AS message
      FROM ev),
s AS (SELECT *, {_sql_skip('message', 'general')} AS skip_reason FROM r WHERE route IN ('process', 'selection'))
SELECT event_id, channel_id, coalesce(thread_ts, ts) AS thread_ts, user_id, message, 'it' AS category, route,
       skip_reason, CASE WHEN skip_reason IS NOT NULL THEN 'INFO_RECEIVED' ELSE 'INQUIRY' END AS log_type,
       'OPEN' AS status, make_timestamp(CAST(es AS BIGINT) * 1000000) AS created_at
FROM s"""


@register("intake_stream", _INTAKE_SQL)
def q_intake_stream(spark, d):
    """T1 + T2 + S5 + S6: inbound JSON messages streamed through routing, redelivery
    dedupe, mention stripping and skip rules into an appended log table."""
    src = jobs.scratch(spark, "inbound")
    _inbound_messages(spark, d).drop("_corrupt_record").write.mode("overwrite").json(src)
    out = jobs.scratch(spark, "intake-out")
    jobs.intake_stream(spark, src, out)
    return spark.read.schema(_INTAKE_SCHEMA).parquet(out)


_INTAKE_SCHEMA = ("event_id string, channel_id string, thread_ts string, user_id string, message string, "
                  "category string, route string, skip_reason string, log_type string, status string, "
                  "created_at timestamp_ntz")


@register("sla_breach_stream", """
WITH ev AS (SELECT thread_ts AS ticket_id, priority AS urgency, status, created_at AS evt, id AS seq FROM logs
            WHERE thread_ts IS NOT NULL AND log_type IN ('INQUIRY', 'EVALUATION')),
wm AS (SELECT max(evt) - INTERVAL 10 MINUTE AS t FROM ev),
closed AS (SELECT ticket_id, max({'evt': evt, 'seq': seq}) AS last FROM ev WHERE status IN ('RESOLVED', 'CLOSED') GROUP BY ticket_id),
armed AS (SELECT ev.ticket_id, min(evt) AS opened, arg_min(urgency, {'evt': evt, 'seq': seq}) AS urgency
          FROM ev LEFT JOIN closed USING (ticket_id)
          WHERE status NOT IN ('RESOLVED', 'CLOSED') AND (last IS NULL OR {'evt': evt, 'seq': seq} > last) GROUP BY ev.ticket_id),
due AS (SELECT ticket_id, urgency, coalesce(CASE urgency WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 8 WHEN 'LOW' THEN 24 END, 8) AS h, opened FROM armed)
SELECT ticket_id, 'warning' AS kind, opened + to_hours(h) AS due_at, urgency FROM due, wm WHERE opened + to_minutes(h * 45) <= t
UNION ALL SELECT ticket_id, 'breach', opened + to_hours(h), urgency FROM due, wm WHERE opened + to_hours(h) <= t""", ("logs",))
def q_sla_breach_stream(spark, d):
    """SLA warning/breach notices from the log stream, by event time. A thread opens at its first inquiry with the
    priority as urgency; a RESOLVED row closes it. The catch-up takes the events
    as one batch, so a notice is due when its time is at or before the final
    watermark (the last event less 10 minutes) and no closing row came."""
    logs = A.logs_of(A.events_stream(spark, d))
    ev = logs.where(F.col("thread_ts").isNotNull() & F.col("log_type").isin("INQUIRY", "EVALUATION")).select(
        F.col("thread_ts").alias("ticket_id"), F.col("priority").alias("urgency"), "status",
        F.col("created_at").alias("at"), F.col("id").alias("seq"))
    base = jobs.scratch(spark, "sla")
    jobs.sla_breach_stream(spark, ev, base)
    return jobs.sla_notices(spark, base).withColumn("due_at", F.col("due_at").cast("timestamp_ntz"))



@register("intake_rejected", """
SELECT CASE WHEN conv_id % 11 = 0 THEN NULL ELSE CAST(conv_id * 1000 + turn AS VARCHAR) END AS event_id,
       CASE WHEN conv_id % 11 = 0 THEN 'corrupt JSON' ELSE 'bad event_ts' END AS reject_reason
FROM conversations WHERE conv_id % 11 = 0 OR conv_id % 7 = 0""")
def q_intake_rejected(spark, d):
    """T1 + S5: messages the intake cannot take, with the reason; the stream goes on. Of the
    inbound lines, every 11th conversation's are cut short and every 7th's carry no time."""
    src = jobs.scratch(spark, "inbound")
    cv = A.read(spark, d, "conversations")
    line = F.to_json(F.struct(
        (F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("event_id"), F.lit("message").alias("type"),
        F.lit("im").alias("channel_type"), F.col("text").alias("message"),
        F.when(F.col("conv_id") % 7 == 0, "soon").otherwise("1704067200").alias("event_ts")))
    cv.select(F.when(F.col("conv_id") % 11 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(src)
    out = jobs.scratch(spark, "intake-out")
    jobs.intake_stream(spark, src, out)
    return spark.read.schema("reject_reason string, event_id string").parquet(out + "_rejected")


@register("daily_stats_upkeep", """
WITH s AS (SELECT ticket_id, created_at, category,
  CASE WHEN log_id % 3 = 0 THEN 'HIGH' ELSE priority END AS priority,
  CASE WHEN log_id % 2 = 0 OR log_id % 3 = 0 THEN status ELSE 'OPEN' END AS status,
  CASE WHEN log_id % 2 = 0 OR log_id % 3 = 0 THEN resolved_at END AS resolved_at FROM tickets)
SELECT date_trunc('day', created_at) AS ticket_date, category, priority, count(*) AS ticket_count,
       count(*) FILTER (WHERE status = 'OPEN') AS open_count, count(*) FILTER (WHERE status = 'RESOLVED') AS resolved_count,
       round(avg(CASE WHEN resolved_at IS NOT NULL THEN date_diff('minute', created_at, resolved_at) END), 6) AS avg_resolution_minutes
FROM s GROUP BY 1, 2, 3""", ("tickets",))
def q_daily_stats_upkeep(spark, d):
    """A1 kept by S4: every ticket opens; two batches of changes, one of them replayed and one with
    older rows that must not win, move contributions between and out of the stored days."""
    t = A.tickets(spark, d).select("ticket_id", "log_id", "created_at", "category", "priority", "status", "resolved_at")
    at = lambda n: F.lit(n).alias("updated_at")
    cols = ["ticket_id", "created_at", "category"]
    opened = t.select(*cols, "priority", F.lit("OPEN").alias("status"), F.lit(None).cast("timestamp_ntz").alias("resolved_at"), at(0))
    second = t.where("log_id % 2 = 0").select(*cols, "priority", "status", "resolved_at", at(1))
    third = t.where("log_id % 3 = 0").select(*cols, F.lit("HIGH").alias("priority"), "status", "resolved_at", at(2)).unionByName(
        t.where("log_id % 5 = 0").select(*cols, F.lit("LOW").alias("priority"), F.lit("CLOSED").alias("status"), "resolved_at", at(-1)))
    tickets, days = jobs.scratch(spark, "tickets"), jobs.scratch(spark, "days")
    for batch_id, batch in ((0, opened), (1, second), (1, second), (2, third)):
        upkeep.keep_daily_stats(batch, batch_id, tickets, days)
    return round_doubles(upkeep.daily_stats(spark, days))


@register("create_tickets_batches", """
SELECT 'TKT-' || strftime(created_at, '%Y%m%d') || '-' || lpad(CAST(rn AS VARCHAR), CAST(greatest(5, length(CAST(rn AS VARCHAR))) AS INTEGER), '0') AS ticket_id,
       id AS request_id, created_at
FROM (SELECT *, row_number() OVER (ORDER BY id % 3, created_at, id) AS rn FROM logs WHERE log_type = 'INQUIRY')""", ("logs",))
def q_create_tickets_batches(spark, d):
    """R2 + W6 over three batches of requests, one replayed: numbers go on and never repeat."""
    req = A.logs(spark, d).where(F.col("log_type") == "INQUIRY").select(
        F.col("id").alias("request_id"), "created_at", F.col("channel_id").alias("source_channel"))
    base = jobs.scratch(spark, "numbered")
    for batch_id in (0, 1, 1, 2):
        upkeep.create_tickets_batch(req.where(F.col("request_id") % 3 == batch_id), batch_id, base)
    return sinks.read_current(spark, base).select("ticket_id", "request_id", "created_at")
