"""Registered KPI queries (A1-A12, A16-A20, E1, E2, J9) over the adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketflow.functions import sla
from ticketflow.operators import kpi
from ticketflow.plans.registry import LOGS_AS_OF, TICKETS_AS_OF, register, round_doubles
from ticketflow.sources import adapters as A
from ticketflow.sources.tables import seed_settings


@register("ticket_stats_daily", """
SELECT date_trunc('day', created_at) AS ticket_date, category, priority,
       count(*) AS ticket_count,
       count(*) FILTER (WHERE status = 'OPEN') AS open_count,
       count(*) FILTER (WHERE status = 'RESOLVED') AS resolved_count,
       round(avg(CASE WHEN resolved_at IS NOT NULL
                      THEN date_diff('minute', created_at, resolved_at) END), 6) AS avg_resolution_minutes
FROM tickets GROUP BY 1, 2, 3""", ("tickets",))
def q_ticket_stats_daily(spark, d):
    """A1 tickets per day, category and priority with average resolution minutes."""
    return round_doubles(kpi.ticket_stats_daily(A.tickets(spark, d)))


@register("ticket_stats_daily_by_issue", """
SELECT date_trunc('day', created_at) AS ticket_date, issue_type, urgency,
       count(*) AS ticket_count,
       count(*) FILTER (WHERE status = 'OPEN') AS open_count,
       count(*) FILTER (WHERE status = 'RESOLVED') AS resolved_count,
       round(avg(CASE WHEN resolved_at IS NOT NULL
                      THEN date_diff('minute', created_at, resolved_at) END), 6) AS avg_resolution_minutes
FROM tickets GROUP BY 1, 2, 3""", ("tickets",))
def q_ticket_stats_daily_by_issue(spark, d):
    """A1 variant keyed on issue_type and urgency."""
    return round_doubles(kpi.ticket_stats_daily(A.tickets(spark, d), keys=("issue_type", "urgency")))


@register("ticket_stats_by_department", """
SELECT department, category, count(*) AS total_tickets,
       count(*) FILTER (WHERE status = 'OPEN') AS open_tickets,
       count(*) FILTER (WHERE priority = 'HIGH') AS high_priority_count,
       max(created_at) AS last_ticket_at
FROM tickets GROUP BY 1, 2""", ("tickets",))
def q_ticket_stats_by_department(spark, d):
    """A2 per department and category."""
    return kpi.ticket_stats_by_department(A.tickets(spark, d))


@register("ticket_stats_by_location", """
SELECT location, issue_type, count(*) AS total_tickets,
       count(*) FILTER (WHERE status = 'OPEN') AS open_tickets,
       count(*) FILTER (WHERE urgency = 'HIGH') AS high_urgency_count,
       max(created_at) AS last_ticket_at
FROM tickets GROUP BY 1, 2""", ("tickets",))
def q_ticket_stats_by_location(spark, d):
    """A3 per location and issue type."""
    return kpi.ticket_stats_by_location(A.tickets(spark, d))


_KPI_SQL = f"""
SELECT count(*) AS total_tickets,
  CAST(sum(CASE WHEN CAST(created_at AS DATE) = DATE '{TICKETS_AS_OF[:10]}' THEN 1 ELSE 0 END) AS BIGINT) AS today_tickets,
  CAST(sum(CASE WHEN status = 'OPEN' THEN 1 ELSE 0 END) AS BIGINT) AS open_tickets,
  CAST(sum(CASE WHEN status = 'IN_PROGRESS' THEN 1 ELSE 0 END) AS BIGINT) AS in_progress_tickets,
  CAST(sum(CASE WHEN status = 'RESOLVED' THEN 1 ELSE 0 END) AS BIGINT) AS resolved_tickets,
  CAST(sum(CASE WHEN category = 'HARDWARE' THEN 1 ELSE 0 END) AS BIGINT) AS hardware_tickets,
  CAST(sum(CASE WHEN category = 'SOFTWARE' THEN 1 ELSE 0 END) AS BIGINT) AS software_tickets,
  CAST(sum(CASE WHEN priority = 'HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_priority_tickets,
  round(avg(CASE WHEN resolved_at IS NOT NULL
                 THEN date_diff('minute', created_at, resolved_at) END), 6) AS avg_resolution_minutes
FROM tickets"""


@register("ticket_kpi_summary", _KPI_SQL, ("tickets",))
def q_ticket_kpi_summary(spark, d):
    """A4 one-row KPI summary as of a fixed date."""
    return round_doubles(kpi.ticket_kpi_summary(A.tickets(spark, d), TICKETS_AS_OF))


@register("today_open_counts", f"""
SELECT CAST(sum(CASE WHEN CAST(created_at AS DATE) = DATE '{TICKETS_AS_OF[:10]}' THEN 1 ELSE 0 END) AS BIGINT) AS today_tickets,
       CAST(sum(CASE WHEN status = 'OPEN' THEN 1 ELSE 0 END) AS BIGINT) AS open_tickets
FROM tickets""", ("tickets",))
def q_today_open_counts(spark, d):
    """A16 today's and open ticket counts."""
    return kpi.today_open_counts(A.tickets(spark, d), TICKETS_AS_OF)


@register("v_ticket_summary", """
SELECT CAST(created_at AS DATE) AS date, status, issue_type, urgency, count(*) AS ticket_count,
       round(avg(epoch(resolved_at - created_at) / 3600), 6) AS avg_resolution_hours
FROM tickets GROUP BY 1, 2, 3, 4""", ("tickets",))
def q_v_ticket_summary(spark, d):
    """A5 per date, status, issue type, urgency with fractional resolution hours."""
    return round_doubles(kpi.v_ticket_summary(A.tickets(spark, d)))


@register("v_daily_kpi", """
SELECT CAST(created_at AS DATE) AS date,
  count(*) FILTER (WHERE log_type = 'INQUIRY') AS total_inquiries,
  count(*) FILTER (WHERE log_type = 'AI_RESPONSE') AS ai_responses,
  count(*) FILTER (WHERE status = 'RESOLVED') AS resolved,
  count(*) FILTER (WHERE status = 'ESCALATED') AS escalated,
  CAST(round(CAST(count(*) FILTER (WHERE status = 'RESOLVED') AS DECIMAL(38, 10)) * 100
        / NULLIF(count(*) FILTER (WHERE log_type = 'INQUIRY'), 0), 2) AS DOUBLE) AS resolution_rate,
  round(avg(tokens_input + tokens_output) FILTER (WHERE log_type = 'AI_RESPONSE'), 6) AS avg_tokens
FROM logs GROUP BY 1""", ("logs",))
def q_v_daily_kpi(spark, d):
    """A6 daily log KPIs with the reference resolution-rate formula."""
    return round_doubles(kpi.v_daily_kpi(A.logs(spark, d)))


@register("v_daily_kpi_conversations", """
SELECT CAST(created_at AS DATE) AS date,
  count(*) FILTER (WHERE log_type = 'INQUIRY') AS total_inquiries,
  count(*) FILTER (WHERE log_type = 'AI_RESPONSE') AS ai_responses,
  count(*) FILTER (WHERE status = 'RESOLVED') AS resolved,
  count(*) FILTER (WHERE status = 'ESCALATED') AS escalated,
  CAST(round(CAST(count(*) FILTER (WHERE status = 'RESOLVED') AS DECIMAL(38, 10)) * 100
        / NULLIF(count(*) FILTER (WHERE log_type = 'INQUIRY'), 0), 2) AS DOUBLE) AS resolution_rate,
  CAST(NULL AS DOUBLE) AS avg_tokens
FROM conversation GROUP BY 1""", ("conversation",))
def q_v_daily_kpi_conversations(spark, d):
    """A6 over conversation logs, which carry no token columns (avg_tokens NULL)."""
    conv = A.conversation(spark, d).withColumn("tokens_input", F.lit(None).cast("int")) \
        .withColumn("tokens_output", F.lit(None).cast("int"))
    return round_doubles(kpi.v_daily_kpi(conv))


@register("asset_stats", """
SELECT asset_type, count(*) AS asset_count,
       sum(count(*)) OVER () AS total_assets,
       sum(count(*) FILTER (WHERE status = 'MAINTENANCE')) OVER () AS repair_count
FROM assets GROUP BY asset_type""", ("assets",))
def q_asset_stats(spark, d):
    """A7 asset counts by type with whole-table total and repair count."""
    return kpi.asset_stats(A.assets(spark, d)).select(
        "asset_type", "asset_count", F.col("total_assets").cast("long").alias("total_assets"),
        F.col("repair_count").cast("long").alias("repair_count"))


@register("status_distribution", """
SELECT status, count(*) AS ticket_count, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM tickets GROUP BY status""", ("tickets",))
def q_status_distribution(spark, d):
    """A8 status distribution with shares."""
    return round_doubles(kpi.distribution(A.tickets(spark, d), "status"))


@register("urgency_distribution", """
SELECT urgency, count(*) AS ticket_count, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM tickets GROUP BY urgency""", ("tickets",))
def q_urgency_distribution(spark, d):
    """A8 urgency distribution with shares."""
    return round_doubles(kpi.distribution(A.tickets(spark, d), "urgency"))


@register("top_issue_types", """
SELECT issue_type, count(*) AS ticket_count FROM tickets GROUP BY issue_type
ORDER BY ticket_count DESC, issue_type LIMIT 10""", ("tickets",))
def q_top_issue_types(spark, d):
    """A9 top 10 issue types."""
    return kpi.top_issue_types(A.tickets(spark, d), 10)


@register("top_departments", """
SELECT department, count(*) AS ticket_count FROM tickets GROUP BY department
ORDER BY ticket_count DESC, department LIMIT 10""", ("tickets",))
def q_top_departments(spark, d):
    """A9 top-k over a high-cardinality key (department)."""
    return kpi.top_issue_types(A.tickets(spark, d), 10, "department")


@register("trend_7d", f"""
WITH spine AS (
  SELECT CAST(x AS DATE) AS date
  FROM range(DATE '{TICKETS_AS_OF[:10]}' - INTERVAL 6 DAY, DATE '{TICKETS_AS_OF[:10]}' + INTERVAL 1 DAY,
             INTERVAL 1 DAY) t(x)),
c AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM tickets GROUP BY 1),
r AS (SELECT CAST(resolved_at AS DATE) AS day, count(*) AS n FROM tickets
      WHERE resolved_at IS NOT NULL GROUP BY 1)
SELECT s.date, coalesce(c.n, 0) AS created, coalesce(r.n, 0) AS resolved
FROM spine s LEFT JOIN c ON s.date = c.day LEFT JOIN r ON s.date = r.day""", ("tickets",))
def q_trend_7d(spark, d):
    """A10 seven-day created/resolved trend, zero filled."""
    return kpi.trend_days(A.tickets(spark, d), TICKETS_AS_OF, 7)


@register("trend_30d_logs", f"""
WITH spine AS (
  SELECT CAST(x AS DATE) AS date
  FROM range(DATE '{LOGS_AS_OF[:10]}' - INTERVAL 29 DAY, DATE '{LOGS_AS_OF[:10]}' + INTERVAL 1 DAY,
             INTERVAL 1 DAY) t(x)),
c AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM logs GROUP BY 1),
r AS (SELECT CAST(resolved_at AS DATE) AS day, count(*) AS n FROM logs
      WHERE resolved_at IS NOT NULL GROUP BY 1)
SELECT s.date, coalesce(c.n, 0) AS created, coalesce(r.n, 0) AS resolved
FROM spine s LEFT JOIN c ON s.date = c.day LEFT JOIN r ON s.date = r.day""", ("logs",))
def q_trend_30d_logs(spark, d):
    """A10 with days=30 over log rows (spine reaches before the first row)."""
    return kpi.trend_days(A.logs(spark, d), LOGS_AS_OF, 30)


@register("resolution_summary", """
WITH a AS (
  SELECT count(*) AS total_tickets,
         count(*) FILTER (WHERE status IN ('RESOLVED', 'CLOSED')) AS resolved_tickets,
         avg(CASE WHEN resolved_at IS NOT NULL THEN epoch(resolved_at - created_at) / 3600 END) AS h
  FROM tickets)
SELECT total_tickets, resolved_tickets,
  CASE WHEN total_tickets > 0 THEN printf('%.1f', resolved_tickets / total_tickets * 100.0) ELSE '0' END
    AS resolution_rate,
  total_tickets - resolved_tickets AS open_tickets,
  round(h, 6) AS avg_resolution_hours,
  CASE WHEN h IS NULL THEN 'N/A' WHEN h < 24 THEN printf('%.1f', h) || '時間'
       ELSE printf('%.1f', h / 24.0) || '日' END AS avg_resolution_text
FROM a""", ("tickets",))
def q_resolution_summary(spark, d):
    """A11 resolution summary with the display text."""
    return round_doubles(kpi.resolution_summary(A.tickets(spark, d)))


@register("queue_stats", """
SELECT count(*) AS total,
       count(*) FILTER (WHERE status IN ('OPEN', 'HUMAN_REQUESTED')) AS open,
       count(*) FILTER (WHERE status = 'IN_PROGRESS') AS in_progress,
       count(*) FILTER (WHERE status IN ('OPEN', 'IN_PROGRESS', 'HUMAN_REQUESTED') AND urgency = 'HIGH')
         AS high_urgency
FROM tickets""", ("tickets",))
def q_queue_stats(spark, d):
    """A12 dashboard cards over the whole set."""
    return kpi.queue_stats(A.tickets(spark, d))


@register("queue_stats_by_queue", """
SELECT queue, count(*) AS total,
       count(*) FILTER (WHERE status IN ('OPEN', 'HUMAN_REQUESTED')) AS open,
       count(*) FILTER (WHERE status = 'IN_PROGRESS') AS in_progress,
       count(*) FILTER (WHERE status IN ('OPEN', 'IN_PROGRESS', 'HUMAN_REQUESTED') AND urgency = 'HIGH')
         AS high_urgency
FROM tickets GROUP BY queue""", ("tickets",))
def q_queue_stats_by_queue(spark, d):
    """A12 cards per queue (IT/HR/finance/general)."""
    t = A.tickets(spark, d)
    st = F.col("status")
    return t.groupBy("queue").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(st.isin("OPEN", "HUMAN_REQUESTED")).alias("open"),
        F.count_if(st == "IN_PROGRESS").alias("in_progress"),
        F.count_if(st.isin(*kpi.ACTIVE) & (F.col("urgency") == "HIGH")).alias("high_urgency"))


@register("view_leaderboard", """
WITH v AS (SELECT article_id, count(*) AS n FROM article_views GROUP BY article_id)
SELECT k.id, k.category, CAST(k.views AS BIGINT) + coalesce(v.n, 0) AS views
FROM knowledge k LEFT JOIN v ON k.id = v.article_id
ORDER BY views DESC, k.id""", ("knowledge", "article_views"))
def q_view_leaderboard(spark, d):
    """P7 + A17: every article, view counters bumped by view events, most viewed first."""
    return kpi.view_leaderboard(A.knowledge(spark, d), A.article_views(spark, d))


@register("article_views_bumped", """
WITH v AS (SELECT article_id, count(*) AS n FROM article_views GROUP BY article_id)
SELECT k.id, CAST(k.views AS BIGINT) + coalesce(v.n, 0) AS views
FROM knowledge k LEFT JOIN v ON k.id = v.article_id""", ("knowledge", "article_views"))
def q_article_views_bumped(spark, d):
    """P7 bump_counter over every article."""
    return kpi.bump_counter(A.knowledge(spark, d), A.article_views(spark, d)).select("id", "views")


@register("feedback_quality", """
SELECT category, count(*) AS articles, sum(CAST(helpful AS BIGINT)) AS helpful,
       sum(CAST(not_helpful AS BIGINT)) AS not_helpful, sum(CAST(views AS BIGINT)) AS views,
       round(CAST(sum(helpful) AS DOUBLE) / NULLIF(sum(helpful) + sum(not_helpful), 0), 6) AS helpful_ratio
FROM knowledge GROUP BY category""", ("knowledge",))
def q_feedback_quality(spark, d):
    """A19 helpful/not-helpful counters per category."""
    return round_doubles(kpi.feedback_quality(A.knowledge(spark, d)))


_PROFILED = {
    "logs": "id log_type inquiry_id user_id channel_id thread_ts message category priority ai_response_text tokens_input "
            "tokens_output evaluation status created_at resolved_at",
    "tickets": "ticket_id reporter_name reporter_employee_id location department issue_type category urgency priority summary "
               "log_id thread_ts source_channel queue status assigned_to created_at updated_at resolved_at",
    "knowledge": "id title content category subcategory tags views author helpful not_helpful created_at",
}


@register("column_profile", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, {i} AS ordinal, '{c}' AS column_name, "
    f"count(*) FILTER ({c} IS NULL) AS null_count, count(DISTINCT {c}) AS distinct_count FROM {t}"
    for t, cols in _PROFILED.items() for i, c in enumerate(cols.split(), 1)), ("logs", "tickets", "knowledge"))
def q_column_profile(spark, d):
    """Row, null and distinct counts of every column of three tables, unioned."""
    return kpi.column_profile({"logs": A.logs(spark, d), "tickets": A.tickets(spark, d), "knowledge": A.knowledge(spark, d)})


@register("sla_state", f"""
WITH s AS (
  SELECT ticket_id, urgency, status, created_at,
    coalesce(CASE urgency WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 8 WHEN 'LOW' THEN 24 END, 8) AS sla_hours,
    epoch_us(TIMESTAMP '{TICKETS_AS_OF}') // 1000 AS now_ms, epoch_us(created_at) // 1000 AS c_ms
  FROM tickets),
m AS (SELECT *, CAST(sla_hours AS BIGINT) * 3600000 AS total, c_ms + CAST(sla_hours AS BIGINT) * 3600000 - now_ms AS rem,
             now_ms - c_ms AS elapsed, status IN ('RESOLVED', 'CLOSED') AS done FROM s),
f AS (SELECT *, CAST(floor(rem / 3600000) AS BIGINT) AS rh, CAST(floor((rem % 3600000) / 60000) AS BIGINT) AS rm FROM m)
SELECT ticket_id, sla_hours,
  CASE WHEN done THEN 'done' WHEN rem < 0 THEN 'overdue' WHEN rem > 0 AND rem < total * 0.25 THEN 'warning'
       ELSE 'normal' END AS sla_state,
  CASE WHEN NOT done THEN rem END AS remaining_ms,
  CASE WHEN NOT done THEN rh END AS remaining_h,
  CASE WHEN NOT done THEN rm END AS remaining_m,
  round(CASE WHEN NOT done THEN (CASE WHEN rem < 0 THEN 100.0 ELSE least(100.0, elapsed / total * 100.0) END) END, 6)
    AS progress_pct,
  CASE WHEN done THEN '完了'
       WHEN rem < 0 THEN 'SLA超過 ' || CAST(abs(rh) AS VARCHAR) || 'h' || CAST(abs(rm) AS VARCHAR) || 'm'
       ELSE '残り ' || CAST(rh AS VARCHAR) || 'h' || CAST(rm AS VARCHAR) || 'm' END AS sla_text,
  CASE WHEN NOT done AND rem < 0 THEN CAST(floor(-rem / 60000) AS BIGINT) END AS overdue_minutes
FROM f""", ("tickets",))
def q_sla_state(spark, d):
    """E1 SLA state, remaining time, progress and display text as of a fixed time."""
    t = A.tickets(spark, d).select("ticket_id", "urgency", "status", "created_at")
    out = sla.sla_state(t, TICKETS_AS_OF)
    return round_doubles(out.select(
        "ticket_id", F.col("sla_hours").cast("int").alias("sla_hours"), "sla_state", "remaining_ms",
        F.col("remaining_h").cast("long").alias("remaining_h"),
        F.col("remaining_m").cast("long").alias("remaining_m"),
        "progress_pct", "sla_text", F.col("overdue_minutes").cast("long").alias("overdue_minutes")))


@register("sla_settings_lookup", """
SELECT ticket_id, urgency, coalesce(CASE urgency WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 8 WHEN 'LOW' THEN 24 END, 8)
       AS sla_hours,
       CASE WHEN coalesce(CASE urgency WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 8 WHEN 'LOW' THEN 24 END, 8) < 24
            THEN CAST(coalesce(CASE urgency WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 8 WHEN 'LOW' THEN 24 END, 8) AS VARCHAR) || '時間'
            ELSE CAST(CAST(floor(coalesce(CASE urgency WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 8 WHEN 'LOW' THEN 24 END, 8) / 24.0 + 0.5) AS BIGINT) AS VARCHAR) || '営業日'
       END AS sla_label
FROM tickets""", ("tickets",))
def q_sla_settings_lookup(spark, d):
    """J9 + E2: SLA hours read from the settings table (seed values), formatted."""
    t = A.tickets(spark, d).select("ticket_id", "urgency")
    out = sla.sla_lookup(t, seed_settings(spark))
    return out.select("ticket_id", "urgency", F.col("sla_hours").cast("int").alias("sla_hours"),
                      sla.format_sla(F.col("sla_hours")).alias("sla_label"))


def _response_times(spark, d):
    """The J8 chain as A20 input."""
    from ticketflow.operators import threads
    return threads.reply_chain(A.logs(spark, d)).select(
        "category", F.struct("response_id", "evaluation_id").alias("response_id"),
        F.lit(None).cast("double").alias("confidence_score"),
        (F.col("outcome") == "resolved").alias("was_helpful"),
        F.col("response_ms").alias("response_time_ms"), (F.col("outcome") == "escalated").alias("escalated"))


@register("ai_quality", """
WITH i AS (SELECT id AS inquiry_id, created_at AS inq_at, category FROM logs WHERE log_type = 'INQUIRY'),
r AS (SELECT id AS response_id, inquiry_id AS r_inq, created_at AS resp_at FROM logs WHERE log_type = 'AI_RESPONSE'),
e AS (SELECT id AS evaluation_id, inquiry_id AS e_resp FROM logs WHERE log_type = 'EVALUATION'),
c AS (SELECT category, epoch_us(resp_at) // 1000 - epoch_us(inq_at) // 1000 AS ms
      FROM i JOIN r ON inquiry_id = r_inq LEFT JOIN e ON response_id = e_resp)
SELECT category, count(*) AS responses, round(avg(ms), 6) AS avg_response_ms,
       round(quantile_cont(ms, 0.5), 6) AS p50_response_ms, round(quantile_cont(ms, 0.95), 6) AS p95_response_ms
FROM c GROUP BY category""", ("logs",))
def q_ai_quality(spark, d):
    """A20 response times per category: mean and exact p50/p95 of AI_RESPONSE minus its INQUIRY."""
    out = kpi.ai_quality(_response_times(spark, d), "category")
    return round_doubles(out.select("category", "responses", "avg_response_ms", "p50_response_ms", "p95_response_ms"))


@register("ai_confidence", """
WITH c AS (SELECT conv_id, turn, conv_id * 10 + turn AS k FROM conversations WHERE role = 'assistant'),
e AS (SELECT *, k % 5 = 4 AS err, k % 5 = 3 OR k % 7 = 0 AS no_json,
             ['HARDWARE', 'SOFTWARE', 'ACCOUNT', 'OTHER'][k % 4 + 1] AS cat FROM c)
SELECT CASE WHEN err THEN 'ERROR' WHEN no_json THEN 'OTHER' ELSE cat END AS category, count(*) AS responses,
       round(avg(CASE WHEN NOT err THEN CAST(printf('%.2f', (k % 100) / 100.0) AS DOUBLE) END), 6) AS avg_confidence,
       round(avg(CASE WHEN err THEN 1.0 WHEN no_json THEN 0.0 WHEN k % 2 = 0 THEN 1.0 ELSE 0.0 END), 6) AS escalation_rate
FROM e GROUP BY 1""")
def q_ai_confidence(spark, d):
    """A20 confidence per category, from the agent responses that E10 parses (top search score)."""
    from ticketflow.functions import agent
    from ticketflow.plans.text_queries import _agent_inputs
    parsed = agent.parse_agent_response(_agent_inputs(spark, d)).select(
        "category", F.struct("conv_id", "turn").alias("response_id"),
        F.try_element_at(F.col("confidence_scores"), F.lit(1))["score"].alias("confidence_score"),
        (~F.col("needs_escalation")).alias("was_helpful"), F.lit(None).cast("long").alias("response_time_ms"),
        F.col("needs_escalation").alias("escalated"))
    out = kpi.ai_quality(parsed, "category")
    return round_doubles(out.select("category", "responses", "avg_confidence", "escalation_rate"))


@register("ai_quality_rates", """
WITH i AS (SELECT id AS inquiry_id, created_at AS inq_at, category FROM logs WHERE log_type = 'INQUIRY'),
r AS (SELECT id AS response_id, inquiry_id AS r_inq, created_at AS resp_at FROM logs WHERE log_type = 'AI_RESPONSE'),
e AS (SELECT id AS evaluation_id, inquiry_id AS e_resp, evaluation FROM logs WHERE log_type = 'EVALUATION'),
c AS (SELECT category, epoch_us(resp_at) // 1000 - epoch_us(inq_at) // 1000 AS ms,
             CASE WHEN evaluation_id IS NULL THEN 'pending' WHEN evaluation IN ('resolved', 'helpful') THEN 'resolved'
                  WHEN evaluation = 'escalate' THEN 'escalated' WHEN evaluation = 'direct_ticket' THEN 'human'
                  ELSE evaluation END AS outcome
      FROM i JOIN r ON inquiry_id = r_inq LEFT JOIN e ON response_id = e_resp)
SELECT category, count(*) AS responses,
       round(avg(CASE WHEN outcome = 'resolved' THEN 1.0 ELSE 0.0 END), 6) AS helpful_rate,
       round(avg(CASE WHEN outcome = 'escalated' THEN 1.0 ELSE 0.0 END), 6) AS escalation_rate,
       round(avg(ms), 6) AS avg_response_ms
FROM c GROUP BY category""", ("logs",))
def q_ai_quality_rates(spark, d):
    """A20 (exact part) per category over the J8 chain: helpful and escalation rates, mean latency."""
    out = kpi.ai_quality(_response_times(spark, d), "category")
    return round_doubles(out.select("category", "responses", "helpful_rate", "escalation_rate", "avg_response_ms"))
