"""Registered lifecycle queries (P1-P4, W1, W5, W6, J4-J6, T4, E3, E13, E14, routines)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketflow.operators import lifecycle as L
from ticketflow.plans.registry import TICKETS_AS_OF, register
from ticketflow.sources import adapters as A

_VERSIONS = """
v AS (SELECT *, lag(status) OVER w AS o_status, lag(assigned_to) OVER w AS o_assigned_to,
             lag(resolution_notes) OVER w AS o_resolution_notes, row_number() OVER w AS pos
      FROM ticket_versions WINDOW w AS (PARTITION BY ticket_id ORDER BY changed_at, version_id)),
u AS (
  SELECT ticket_id, changed_at AS created_at, coalesce(author, 'システム') AS author, version_id,
         'status' AS field, 'ステータス' AS field_label, o_status AS old_value, status AS new_value
  FROM v WHERE pos > 1 AND o_status IS DISTINCT FROM status
  UNION ALL
  SELECT ticket_id, changed_at, coalesce(author, 'システム'), version_id, 'assigned_to', '担当者',
         o_assigned_to, assigned_to
  FROM v WHERE pos > 1 AND o_assigned_to IS DISTINCT FROM assigned_to
  UNION ALL
  SELECT ticket_id, changed_at, coalesce(author, 'システム'), version_id, 'resolution_notes', '対応メモ',
         o_resolution_notes, resolution_notes
  FROM v WHERE pos > 1 AND o_resolution_notes IS DISTINCT FROM resolution_notes)"""


@register("change_log", "WITH " + _VERSIONS + "\nSELECT *, '変更' AS action FROM u", ("ticket_versions",))
def q_change_log(spark, d):
    """W5 history rows per changed field between successive ticket versions."""
    return L.change_log(A.ticket_versions(spark, d))


@register("change_log_null_text", "WITH " + _VERSIONS + """
SELECT ticket_id, created_at, author, version_id, field, field_label,
       coalesce(nullif(old_value, ''), 'null') AS old_value, coalesce(nullif(new_value, ''), 'null') AS new_value,
       '変更' AS action FROM u""", ("ticket_versions",))
def q_change_log_null_text(spark, d):
    """W5 with null_text=True: null and '' stored as the text 'null' (reference quirk)."""
    return L.change_log(A.ticket_versions(spark, d), null_text=True)


@register("notification_events", "WITH " + _VERSIONS + """
SELECT ticket_id, CASE field WHEN 'status' THEN 'status_change' WHEN 'assigned_to' THEN 'assignee_change'
                  WHEN 'resolution_notes' THEN 'note' END AS kind,
       author, old_value, new_value, created_at FROM u""", ("ticket_versions",))
def q_notification_events(spark, d):
    """E14 outbox of status/assignee/note notifications from the change log."""
    return L.notification_events(L.change_log(A.ticket_versions(spark, d)))


@register("dedupe_keep_first", """
SELECT id, category, subcategory FROM knowledge
WHERE id IN (SELECT min(id) FROM knowledge GROUP BY title)""", ("knowledge",))
def q_dedupe_keep_first(spark, d):
    """W1 keep the first (min id) article per title."""
    return L.dedupe_keep_first(A.knowledge(spark, d), "title").select("id", "category", "subcategory")


@register("duplicates_to_delete", """
SELECT id FROM knowledge WHERE id NOT IN (SELECT min(id) FROM knowledge GROUP BY title)""", ("knowledge",))
def q_duplicates_to_delete(spark, d):
    """J5 ids removed by the min-id-per-title cleanup."""
    return L.duplicates_to_delete(A.knowledge(spark, d), "title").select("id")


@register("ticket_ordinal", """
SELECT ticket_id, CAST(rn AS BIGINT) AS ordinal,
       'TKT-' || strftime(created_at, '%Y%m%d') || '-' || lpad(CAST(rn AS VARCHAR), CAST(greatest(5, length(CAST(rn AS VARCHAR))) AS INTEGER), '0') AS ordinal_id
FROM (SELECT ticket_id, created_at, row_number() OVER (ORDER BY created_at, ticket_id) AS rn FROM tickets)""",
          ("tickets",))
def q_ticket_ordinal(spark, d):
    """W6 TKT-YYYYMMDD-NNNNN ids from one global (skew-safe) sequence."""
    return L.ticket_ordinal(A.tickets(spark, d).select("ticket_id", "created_at")).select(
        "ticket_id", F.col("ordinal").cast("long").alias("ordinal"), "ordinal_id")


def _candidates(logs, log_type):
    q = F.create_map(*[x for k, v in L.CATEGORY_QUEUE.items() for x in (F.lit(k), F.lit(v))])
    return logs.where(F.col("log_type") == log_type).select(
        "thread_ts", F.coalesce(F.try_element_at(q, F.col("category")), F.lit("general")).alias("queue"),
        "created_at", F.col("id").alias("log_id"), F.col("user_id").alias("reporter_name"))


_CAND = """
{name} AS (
  SELECT thread_ts, CASE category WHEN 'it' THEN 'IT-' WHEN 'it_asset' THEN 'IT-' WHEN 'hr' THEN 'HR-'
                    WHEN 'finance' THEN 'FIN-' ELSE 'GEN-' END AS prefix,
         created_at, id AS log_id, user_id AS reporter_name
  FROM logs WHERE log_type = '{lt}')"""

_PICK = """
{name} AS (
  SELECT * FROM {src} WHERE thread_ts IS NOT NULL AND thread_ts <> ''
  QUALIFY row_number() OVER (PARTITION BY prefix, thread_ts ORDER BY created_at, log_id) = 1
  UNION ALL SELECT * FROM {src} WHERE thread_ts IS NULL OR thread_ts = '')"""

_IDS = """
{name} AS (
  SELECT *, CASE WHEN rn = 1 THEN base ELSE base || '-' || CAST(rn AS VARCHAR) END AS ticket_id FROM (
    SELECT *, row_number() OVER (PARTITION BY base ORDER BY created_at, log_id) AS rn FROM (
      SELECT *, prefix || strftime(created_at, '%Y%m%d-%H%M%S') AS base FROM {src})))"""


@register("open_tickets", "WITH " + ",".join([
    _CAND.format(name="c1", lt="INQUIRY"), _PICK.format(name="f1", src="c1"), _IDS.format(name="t1", src="f1"),
    _CAND.format(name="c2", lt="AI_RESPONSE"), _PICK.format(name="f2", src="c2"),
    """
f2n AS (SELECT * FROM f2 WHERE NOT EXISTS (
  SELECT 1 FROM t1 WHERE t1.thread_ts IS NOT NULL AND t1.thread_ts <> ''
    AND t1.thread_ts = f2.thread_ts AND regexp_extract(t1.ticket_id, '^([A-Z]+-)', 1) = f2.prefix))""",
    """
t2 AS (
  SELECT *, CASE WHEN rn2 = 1 THEN base ELSE base || '-' || CAST(rn2 AS VARCHAR) END AS ticket_id FROM (
    SELECT x.*, x.rn + coalesce(tk.n, 0) AS rn2 FROM (
      SELECT *, row_number() OVER (PARTITION BY base ORDER BY created_at, log_id) AS rn FROM (
        SELECT *, prefix || strftime(created_at, '%Y%m%d-%H%M%S') AS base FROM f2n)) x
    LEFT JOIN (SELECT regexp_extract(ticket_id, '^([A-Z]+-\\d{8}-\\d{6})', 1) AS b, count(*) AS n
               FROM t1 GROUP BY 1) tk ON x.base = tk.b))"""]) + """
SELECT ticket_id, thread_ts, log_id, created_at, reporter_name FROM t2""", ("logs",))
def q_open_tickets(spark, d):
    """J4 + E3: tickets opened by inquiries, then the AI responses whose thread has none yet."""
    logs = A.logs(spark, d)
    first = L.open_tickets(_candidates(logs, "INQUIRY"), None)
    second = L.open_tickets(_candidates(logs, "AI_RESPONSE"), first)
    return second.select("ticket_id", "thread_ts", "log_id", "created_at", "reporter_name")


@register("open_tickets_first_pass", "WITH " + ",".join([
    _CAND.format(name="c1", lt="INQUIRY"), _PICK.format(name="f1", src="c1"), _IDS.format(name="t1", src="f1")]) + """
SELECT ticket_id, thread_ts, log_id, created_at FROM t1""", ("logs",))
def q_open_tickets_first_pass(spark, d):
    """J4 + E3 on an empty ticket table: one ticket per (queue, thread), ids de-collided."""
    first = L.open_tickets(_candidates(A.logs(spark, d), "INQUIRY"), None)
    return first.select("ticket_id", "thread_ts", "log_id", "created_at")


_FB = """
fb AS (SELECT inquiry_id AS log_id, thread_ts, evaluation, created_at AS evt_at, id AS seq,
              CASE WHEN evaluation = 'direct_ticket' THEN 'direct' WHEN evaluation = 'escalate' THEN 'escalate'
                   ELSE 'resolved' END AS branch
       FROM logs WHERE log_type = 'EVALUATION'),
point AS (SELECT log_id,
            arg_max(CASE branch WHEN 'direct' THEN 'HUMAN_REQUESTED' WHEN 'escalate' THEN 'ESCALATED'
                    ELSE 'RESOLVED' END, {'evt_at': evt_at, 'seq': seq}) AS p_status,
            max({'evt_at': evt_at, 'seq': seq}) AS p_at,
            max(evt_at) FILTER (WHERE branch = 'resolved') AS p_resolved_at
          FROM fb GROUP BY log_id),
thr AS (SELECT thread_ts, max({'evt_at': evt_at, 'seq': seq}) AS t_at FROM fb
        WHERE branch = 'resolved' AND thread_ts IS NOT NULL AND thread_ts <> '' GROUP BY thread_ts)"""


@register("apply_feedback_logs", "WITH " + _FB + """
SELECT l.id,
  CASE WHEN thr.t_at IS NOT NULL AND (point.p_at IS NULL OR thr.t_at > point.p_at)
            AND coalesce(point.p_status, l.status) NOT IN ('RESOLVED', 'ESCALATED') THEN 'RESOLVED'
       ELSE coalesce(point.p_status, l.status) END AS status,
  coalesce(point.p_resolved_at, l.resolved_at) AS resolved_at
FROM logs l LEFT JOIN point ON l.id = point.log_id LEFT JOIN thr ON l.thread_ts = thr.thread_ts""", ("logs",))
def q_apply_feedback_logs(spark, d):
    """T4 (batch): fold evaluation events into the log table's status and resolved_at."""
    logs = A.logs(spark, d)
    fb = logs.where(F.col("log_type") == "EVALUATION").select(
        F.col("inquiry_id").alias("log_id"), "thread_ts", "evaluation", F.col("created_at").alias("at"),
        F.col("id").alias("seq"))
    return L.apply_feedback_logs(logs, fb).select("id", "status", "resolved_at")


@register("orphan_check", """
SELECT 'helpdesk_tickets' AS table_name, 'fk_log_id' AS rule, ticket_id AS record_key FROM tickets t
  WHERE log_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM logs l WHERE l.id = t.log_id)
UNION ALL SELECT 'helpdesk_tickets', 'check_status', ticket_id FROM tickets
  WHERE status IS NULL OR status NOT IN ('OPEN', 'IN_PROGRESS', 'RESOLVED', 'CLOSED', 'ESCALATED', 'HUMAN_REQUESTED')
UNION ALL SELECT 'helpdesk_tickets', 'check_urgency', ticket_id FROM tickets
  WHERE urgency IS NOT NULL AND urgency NOT IN ('HIGH', 'MEDIUM', 'LOW')
UNION ALL SELECT 'helpdesk_logs', 'check_log_type', CAST(id AS VARCHAR) FROM logs
  WHERE log_type NOT IN ('INQUIRY', 'AI_RESPONSE', 'EVALUATION', 'INFO_RECEIVED')
UNION ALL SELECT 'helpdesk_logs', 'fk_inquiry_id', CAST(id AS VARCHAR) FROM logs a
  WHERE inquiry_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM logs b WHERE b.id = a.inquiry_id)
UNION ALL SELECT 'assets', 'fk_assignee', asset_id FROM assets a
  WHERE assignee IS NOT NULL AND NOT EXISTS (SELECT 1 FROM employees e WHERE e.employee_name = a.assignee)""",
          ("tickets", "logs", "assets", "employees"))
def q_orphan_check(spark, d):
    """J6 foreign-key and CHECK violations across tickets, logs and assets."""
    return L.orphan_check(A.tickets(spark, d), A.logs(spark, d), A.assets(spark, d), A.employees(spark, d))


_PATCH_NOW = TICKETS_AS_OF


@register("patch_columns", f"""
WITH p AS (
  SELECT l_orderkey AS log_id, {{'n': l_linenumber, 's': l_suppkey, 'f': l_returnflag}} AS seq,
         CASE l_returnflag WHEN 'R' THEN 'RESOLVED' WHEN 'A' THEN NULL ELSE 'IN_PROGRESS' END AS status,
         CASE WHEN l_linenumber % 2 = 0 THEN 'agent' || CAST(l_suppkey % 9 AS VARCHAR) END AS assigned_to,
         CASE WHEN l_linenumber = 1 THEN '' END AS resolution_notes
  FROM lineitem),
f AS (SELECT log_id,
        arg_max(status, seq) FILTER (WHERE status IS NOT NULL) AS n_status,
        arg_max(assigned_to, seq) FILTER (WHERE assigned_to IS NOT NULL) AS n_assigned,
        arg_max(resolution_notes, seq) FILTER (WHERE resolution_notes IS NOT NULL) AS n_notes
      FROM p GROUP BY log_id)
SELECT t.ticket_id, coalesce(n_status, t.status) AS status, coalesce(n_assigned, t.assigned_to) AS assigned_to,
       n_notes AS resolution_notes,
       CASE WHEN f.log_id IS NOT NULL THEN TIMESTAMP '{_PATCH_NOW}' ELSE t.updated_at END AS updated_at,
       CASE WHEN n_status IN ('RESOLVED', 'CLOSED') THEN TIMESTAMP '{_PATCH_NOW}' ELSE t.resolved_at END AS resolved_at
FROM tickets t LEFT JOIN f ON t.log_id = f.log_id""", ("tickets",))
def q_patch_columns(spark, d):
    """P1 + P2: fold a batch of partial updates (line items as patches) into tickets."""
    t = A.tickets(spark, d).withColumn("resolution_notes", F.lit(None).cast("string"))
    li = A.read(spark, d, "lineitem")
    p = li.select(
        F.col("l_orderkey").alias("log_id"),
        # line numbers repeat within an order; ties on the whole struct carry equal patch values
        F.struct(F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"),
                 F.col("l_returnflag").alias("f")).alias("seq"),
        F.when(F.col("l_returnflag") == "R", "RESOLVED").when(F.col("l_returnflag") == "A", F.lit(None))
         .otherwise("IN_PROGRESS").alias("status"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("agent"), (F.col("l_suppkey") % 9).cast("string")))
         .alias("assigned_to"),
        F.when(F.col("l_linenumber") == 1, F.lit("")).alias("resolution_notes"))
    out = L.patch_columns(t, p, "log_id", ["status", "assigned_to", "resolution_notes"], _PATCH_NOW, "seq")
    return out.select("ticket_id", "status", "assigned_to", "resolution_notes", "updated_at", "resolved_at")


@register("routing_columns", """
SELECT ticket_id,
  CASE WHEN starts_with(ticket_id, 'FIN-') THEN 'finance' WHEN starts_with(ticket_id, 'HR-') THEN 'hr' ELSE 'it' END
    AS queue,
  CASE lower(coalesce(nullif(queue, ''), 'it')) WHEN 'hr' THEN 'hr_tickets' WHEN 'finance' THEN 'finance_tickets'
       ELSE 'helpdesk_tickets' END AS target_table,
  CASE WHEN source_channel IS NOT NULL AND source_channel <> '' AND source_channel NOT IN ('slack', 'web', 'email')
       THEN source_channel ELSE 'C-DEFAULT' END AS notify_channel,
  'GEN-' || strftime(created_at, '%Y%m%d-%H%M%S') AS ts_ticket_id
FROM tickets""", ("tickets",))
def q_routing_columns(spark, d):
    """P3 queue_of, P4 table_of_category, E13 resolve_channel, E3 ticket_id_ts."""
    t = A.tickets(spark, d)
    return t.select("ticket_id", L.queue_of("ticket_id").alias("queue"),
                    L.table_of_category("queue").alias("target_table"),
                    L.resolve_channel("source_channel", "C-DEFAULT").alias("notify_channel"),
                    L.ticket_id_ts("GEN-", "created_at").alias("ts_ticket_id"))


@register("create_ticket_actions", """
SELECT 'TKT-' || strftime(created_at, '%Y%m%d') || '-' || lpad(CAST(rn AS VARCHAR), CAST(greatest(5, length(CAST(rn AS VARCHAR))) AS INTEGER), '0') AS ticket_id,
       'CREATED' AS action_type, 'SYSTEM' AS action_by,
       'チケット自動作成: ' || coalesce(source_channel, '') AS action_details, created_at
FROM (SELECT *, row_number() OVER (ORDER BY created_at, request_id) AS rn FROM (
  SELECT id AS request_id, created_at, channel_id AS source_channel FROM logs WHERE log_type = 'INQUIRY'))""",
          ("logs",))
def q_create_ticket_actions(spark, d):
    """create_ticket routine over inquiry rows: ordinal ids and CREATED actions."""
    req = A.logs(spark, d).where(F.col("log_type") == "INQUIRY").select(
        F.col("id").alias("request_id"), "created_at", F.col("channel_id").alias("source_channel"))
    _, actions = L.create_tickets(req)
    return actions


@register("update_ticket_status", f"""
WITH u AS (
  SELECT ticket_id, seq, status, assigned_to, coalesce(action_by, 'SYSTEM') AS action_by FROM (
    SELECT CASE {"c.c_mktsegment"} WHEN 'MACHINERY' THEN 'IT-' WHEN 'BUILDING' THEN 'HR-' WHEN 'FURNITURE' THEN 'FIN-'
                ELSE 'GEN-' END || CAST(l_orderkey AS VARCHAR) AS ticket_id,
           l_linenumber AS seq, CASE l_linestatus WHEN 'F' THEN 'CLOSED' ELSE 'IN_PROGRESS' END AS status,
           CASE WHEN l_linenumber = 1 THEN 'agent' || CAST(l_suppkey % 9 AS VARCHAR) END AS assigned_to,
           NULL AS action_by
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey)),
found AS (SELECT * FROM u WHERE ticket_id IN (SELECT ticket_id FROM tickets))
SELECT ticket_id, 'UPDATED' AS action_type, action_by, 'ステータス変更: ' || status AS action_details,
       TIMESTAMP '{TICKETS_AS_OF}' AS created_at, seq FROM found""", ("tickets",))
def q_update_ticket_status(spark, d):
    """update_ticket_status routine: UPDATED actions for the updates whose ticket exists."""
    t = A.tickets(spark, d).withColumn("resolution_notes", F.lit(None).cast("string"))
    li = A.read(spark, d, "lineitem")
    o = A.read(spark, d, "orders")
    c = A.read(spark, d, "customer")
    seg = F.col("c_mktsegment")
    prefix = (F.when(seg == "MACHINERY", "IT-").when(seg == "BUILDING", "HR-")
              .when(seg == "FURNITURE", "FIN-").otherwise("GEN-"))
    u = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
         .select(F.concat(prefix, F.col("l_orderkey").cast("string")).alias("ticket_id"),
                 F.col("l_linenumber").alias("seq"),
                 F.when(F.col("l_linestatus") == "F", "CLOSED").otherwise("IN_PROGRESS").alias("status"),
                 F.when(F.col("l_linenumber") == 1, F.concat(F.lit("agent"), (F.col("l_suppkey") % 9).cast("string")))
                  .alias("assigned_to"),
                 F.lit(None).cast("string").alias("resolution_notes"),
                 F.lit(None).cast("string").alias("action_by")))
    _, actions, _ = L.update_ticket_status(t, u, TICKETS_AS_OF)
    return actions


@register("ticket_conversation", "WITH " + ",".join([
    _CAND.format(name="c1", lt="INQUIRY"), _PICK.format(name="f1", src="c1"), _IDS.format(name="t1", src="f1")]) + """
SELECT t1.ticket_id, t1.thread_ts, l.id AS log_id, l.log_type, l.message, l.ai_response_text,
       l.created_at AS log_created_at
FROM t1 LEFT JOIN logs l ON l.thread_ts = t1.thread_ts AND l.thread_ts IS NOT NULL AND l.thread_ts <> ''""",
          ("logs",))
def q_ticket_conversation(spark, d):
    """J4 then J1: tickets opened by inquiries, each with every log row of its thread."""
    from ticketflow.operators import threads
    logs = A.logs(spark, d)
    tickets = L.open_tickets(_candidates(logs, "INQUIRY"), None)
    return threads.ticket_conversation(tickets, logs)


@register("ticket_history", "WITH " + _VERSIONS + """
SELECT ticket_id, version_id, field, old_value, new_value,
       row_number() OVER (PARTITION BY ticket_id ORDER BY created_at DESC, version_id DESC, field DESC) AS ordinal
FROM u""", ("ticket_versions",))
def q_ticket_history(spark, d):
    """J3 change history of each ticket, newest first (skew-safe numbering per ticket)."""
    from ticketflow.operators import threads
    hist = L.change_log(A.ticket_versions(spark, d))
    parents = A.ticket_versions(spark, d).select("ticket_id")
    out = threads.children_of(parents, hist, "ticket_id", ["created_at", "version_id", "field"], descending=True)
    return out.select("ticket_id", "version_id", "field", "old_value", "new_value",
                      F.col("ordinal").cast("long").alias("ordinal"))
