"""Registered queries over written tables and state sinks: snapshots, validated
creates, insert-ignore, deletes, incremental export, ticket state routines and
the streaming forms of opening tickets and folding feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketflow.operators import lifecycle as L
from ticketflow.plans.lifecycle_queries import _CAND, _FB, _IDS, _PICK, _candidates
from ticketflow.plans.registry import TICKETS_AS_OF, register
from ticketflow.sources import adapters as A
from ticketflow.sources import tables as TB
from ticketflow.streaming import jobs, sinks


@register("ticket_snapshot_export", """
SELECT ticket_id, reporter_employee_id AS employee_id, reporter_name AS employee_name, department, issue_type AS category,
       urgency AS priority, status, summary AS subject, summary AS description, CAST(NULL AS VARCHAR) AS resolution,
       created_at, updated_at, resolved_at FROM tickets""", ("tickets",))
def q_ticket_snapshot_export(spark, d):
    """A table of open tickets replaced by the whole snapshot, then read through the pointer."""
    base = jobs.scratch(spark, "snapshot")
    snap = TB.ticket_snapshot(A.tickets(spark, d))
    TB.export_snapshot(snap.where(F.col("status") == "OPEN"), base, "v1")
    TB.replace_table(snap, base, "v2")
    return TB.read_snapshot(spark, base)


def _asset_requests(spark, d):
    """Assets as create requests: every 13th without an id, every 10th without a type, RETIRED ones without a status."""
    a = A.assets(spark, d)
    return a.select(
        "id", F.when(F.col("id") % 13 != 0, F.col("asset_id")).otherwise("").alias("asset_id"),
        F.when(F.col("id") % 10 != 0, F.col("asset_type")).alias("asset_type"), "name",
        F.when(F.col("status") != "RETIRED", F.col("status")).alias("status"))


@register("create_assets", f"""
WITH r AS (SELECT id, CASE WHEN id % 13 <> 0 THEN asset_id ELSE '' END AS asset_id,
             CASE WHEN id % 10 <> 0 THEN asset_type END AS asset_type, CASE WHEN status <> 'RETIRED' THEN status END AS status FROM assets)
SELECT id, asset_id, asset_type,
  CASE WHEN asset_id = '' OR asset_type IS NULL THEN status ELSE coalesce(status, 'ACTIVE') END AS status,
  CASE WHEN asset_id = '' OR asset_type IS NULL THEN NULL ELSE TIMESTAMP '{TICKETS_AS_OF}' END AS created_at,
  CASE WHEN asset_id = '' THEN 'missing asset_id' WHEN asset_type IS NULL THEN 'missing asset_type' END AS reject_reason
FROM r""", ("assets",))
def q_create_assets(spark, d):
    """Create requests validated, given defaults and stamps; rejected ones keep their reason."""
    valid, rejected = TB.create_records(_asset_requests(spark, d), ["asset_id", "asset_type"], {"status": "ACTIVE"}, TICKETS_AS_OF)
    cols = ["id", "asset_id", "asset_type", "status"]
    return (valid.select(*cols, "created_at", F.lit(None).cast("string").alias("reject_reason"))
            .unionByName(rejected.select(*cols, F.lit(None).cast("timestamp_ntz").alias("created_at"), "reject_reason")))


@register("insert_ignore_assets", """
SELECT asset_id, name, CASE WHEN status = 'ACTIVE' THEN 0 ELSE 1 END AS version FROM assets""", ("assets",))
def q_insert_ignore_assets(spark, d):
    """ACTIVE assets are stored as version 0; a batch with every asset as versions 2 and 1 then
    adds only those that are missing, each as its first version."""
    path = jobs.scratch(spark, "assets")
    a = A.assets(spark, d)
    row = a.select("asset_id", "name")
    row.join(a.where(F.col("status") == "ACTIVE").select("asset_id"), "asset_id", "left_semi") \
       .withColumn("version", F.lit(0)).write.parquet(path)
    batch = row.withColumn("version", F.explode(F.array(F.lit(2), F.lit(1))))
    TB.insert_ignore(batch, path, ["asset_id"], ["version"])
    return spark.read.parquet(path)


@register("delete_assets", "SELECT id, asset_id, status FROM assets WHERE status <> 'RETIRED'", ("assets",))
def q_delete_assets(spark, d):
    """RETIRED assets deleted by id."""
    a = A.assets(spark, d).select("id", "asset_id", "status")
    return TB.delete_records(a, a.where(F.col("status") == "RETIRED").select("id"), "id")


@register("export_incremental", """
SELECT user_id, id, log_type, status, created_at FROM logs
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY id DESC) = 1""", ("logs",))
def q_export_incremental(spark, d):
    """The newest log row of each user, exported by two runs of the same job (the second finds nothing new)."""
    base = jobs.scratch(spark, "export")
    for _ in range(2):
        rows = A.logs_of(A.events_stream(spark, d)).select("user_id", "id", "log_type", "status", "created_at")
        jobs.export_incremental(spark, rows, base, ["user_id"], "id")
    return sinks.read_current(spark, base)


@register("open_tickets_stream", "WITH " + ",".join([
    _CAND.format(name="c1", lt="INQUIRY"), _PICK.format(name="f1", src="c1"), _IDS.format(name="t1", src="f1")]) + """
SELECT ticket_id, thread_ts, log_id, created_at FROM t1""", ("logs",))
def q_open_tickets_stream(spark, d):
    """Tickets opened from the stream of inquiries, equal to the batch result."""
    base = jobs.scratch(spark, "tickets")
    jobs.open_tickets_stream(spark, _candidates(A.logs_of(A.events_stream(spark, d)), "INQUIRY"), base)
    return sinks.read_current(spark, base).select("ticket_id", "thread_ts", "log_id", "created_at")


@register("apply_feedback_stream", "WITH " + _FB + """
SELECT l.id,
  CASE WHEN thr.t_at IS NOT NULL AND (point.p_at IS NULL OR thr.t_at > point.p_at)
            AND coalesce(point.p_status, l.status) NOT IN ('RESOLVED', 'ESCALATED') THEN 'RESOLVED'
       ELSE coalesce(point.p_status, l.status) END AS status,
  coalesce(point.p_resolved_at, l.resolved_at) AS resolved_at
FROM logs l LEFT JOIN point ON l.id = point.log_id LEFT JOIN thr ON l.thread_ts = thr.thread_ts""", ("logs",))
def q_apply_feedback_stream(spark, d):
    """T4: the log state table after the stream of evaluation events, equal to the batch fold."""
    base = jobs.scratch(spark, "log-state")
    sinks.write_version(A.logs(spark, d).select("id", "thread_ts", "status", "resolved_at"), base, -1)
    fb = A.logs_of(A.events_stream(spark, d)).where(F.col("log_type") == "EVALUATION").select(
        F.col("inquiry_id").alias("log_id"), "thread_ts", "evaluation", F.col("created_at").alias("at"), F.col("id").alias("seq"))
    jobs.apply_feedback_stream(spark, fb, base)
    return sinks.read_current(spark, base).select("id", "status", "resolved_at")


@register("apply_feedback_tickets", """
WITH fb AS (SELECT t.ticket_id, l_shipdate AS evt_at, {'n': l_linenumber, 's': l_suppkey, 'p': l_partkey} AS seq,
              CASE l_returnflag WHEN 'R' THEN 'direct' WHEN 'A' THEN 'escalate' ELSE 'resolved' END AS branch
            FROM lineitem JOIN tickets t ON t.log_id = l_orderkey),
f AS (SELECT ticket_id,
        arg_max(CASE branch WHEN 'direct' THEN 'HUMAN_REQUESTED' WHEN 'escalate' THEN 'ESCALATED' ELSE 'RESOLVED' END,
                {'at': evt_at, 'seq': seq}) AS st,
        bool_or(branch = 'direct') AS direct, max(evt_at) FILTER (WHERE branch = 'resolved') AS done_at FROM fb GROUP BY ticket_id)
SELECT t.ticket_id, coalesce(f.st, t.status) AS status, CASE WHEN f.direct THEN 'LOW' ELSE t.urgency END AS urgency,
       coalesce(f.done_at, t.resolved_at) AS resolved_at
FROM tickets t LEFT JOIN f USING (ticket_id)""", ("tickets",))
def q_apply_feedback_tickets(spark, d):
    """T4 on tickets: line items as feedback events, folded into status, urgency and resolved_at."""
    t = A.tickets(spark, d)
    li = A.read(spark, d, "lineitem")
    flag = F.col("l_returnflag")
    fb = li.join(t.select("ticket_id", "log_id"), F.col("l_orderkey") == F.col("log_id")).select(
        "ticket_id", F.when(flag == "R", "direct_ticket").when(flag == "A", "escalate").otherwise("resolved").alias("evaluation"),
        F.col("l_shipdate").alias("at"),
        F.struct(F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).alias("seq"))
    return L.apply_feedback_tickets(t, fb).select("ticket_id", "status", "urgency", "resolved_at")


_UPDATES = """
u AS (SELECT 'IT-' || CAST(o_orderkey AS VARCHAR) AS ticket_id, o_orderkey AS seq,
             CASE WHEN o_orderkey % 3 = 0 THEN 'CLOSED' ELSE 'IN_PROGRESS' END AS status,
             CASE WHEN o_orderkey % 2 = 0 THEN 'agent' || CAST(o_custkey % 9 AS VARCHAR) END AS assigned_to FROM orders)"""


def _updates(spark, d):
    """One status update per order, addressed to the IT queue: some tickets exist there, the others do not."""
    o = A.read(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(F.concat(F.lit("IT-"), k.cast("string")).alias("ticket_id"), k.alias("seq"),
                    F.when(k % 3 == 0, "CLOSED").otherwise("IN_PROGRESS").alias("status"),
                    F.when(k % 2 == 0, F.concat(F.lit("agent"), (F.col("o_custkey") % 9).cast("string"))).alias("assigned_to"),
                    F.lit(None).cast("string").alias("resolution_notes"), F.lit(None).cast("string").alias("action_by"))


@register("update_ticket_state", f"""
WITH {_UPDATES}
SELECT t.ticket_id, coalesce(u.status, t.status) AS status, coalesce(u.assigned_to, t.assigned_to) AS assigned_to,
       CASE WHEN u.status = 'CLOSED' THEN TIMESTAMP '{TICKETS_AS_OF}' ELSE t.resolved_at END AS resolved_at
FROM tickets t LEFT JOIN u USING (ticket_id)""", ("tickets",))
def q_update_ticket_state(spark, d):
    """update_ticket_status routine: every ticket's state after the updates."""
    t = A.tickets(spark, d).withColumn("resolution_notes", F.lit(None).cast("string"))
    state, _, _ = L.update_ticket_status(t, _updates(spark, d), TICKETS_AS_OF)
    return state.select("ticket_id", "status", "assigned_to", "resolved_at")


@register("update_ticket_found", f"""
WITH {_UPDATES}
SELECT ticket_id, seq, ticket_id IN (SELECT ticket_id FROM tickets) AS found FROM u""", ("tickets",))
def q_update_ticket_found(spark, d):
    """update_ticket_status routine: which updates name a ticket that exists."""
    t = A.tickets(spark, d).withColumn("resolution_notes", F.lit(None).cast("string"))
    _, _, found = L.update_ticket_status(t, _updates(spark, d), TICKETS_AS_OF)
    return found.select("ticket_id", "seq", "found")


@register("create_tickets", """
SELECT 'TKT-' || strftime(created_at, '%Y%m%d') || '-' || lpad(CAST(rn AS VARCHAR), CAST(greatest(5, length(CAST(rn AS VARCHAR))) AS INTEGER), '0') AS ticket_id,
       id AS request_id, created_at, channel_id AS source_channel, 'OPEN' AS status
FROM (SELECT *, row_number() OVER (ORDER BY created_at, id) AS rn FROM logs WHERE log_type = 'INQUIRY')""", ("logs",))
def q_create_tickets(spark, d):
    """create_ticket routine: the ticket rows of every inquiry."""
    req = A.logs(spark, d).where(F.col("log_type") == "INQUIRY").select(
        F.col("id").alias("request_id"), "created_at", F.col("channel_id").alias("source_channel"))
    tickets, _ = L.create_tickets(req)
    return tickets.select("ticket_id", "request_id", "created_at", "source_channel", "status")


@register("escalation_check", """
WITH e AS (SELECT 'ESC-' || CAST(o_orderkey AS VARCHAR) AS escalation_id, CASE WHEN o_orderkey % 5 <> 0 THEN 'IT-' || CAST(o_orderkey AS VARCHAR) END AS ticket_id,
             CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 7 END AS feedback_rating FROM orders)
SELECT 'escalation_log' AS table_name, 'check_rating' AS rule, escalation_id AS record_key FROM e WHERE feedback_rating NOT BETWEEN 1 AND 5
UNION ALL SELECT 'escalation_log', 'fk_ticket_id', escalation_id FROM e
  WHERE ticket_id IS NOT NULL AND ticket_id NOT IN (SELECT ticket_id FROM tickets)""", ("tickets",))
def q_escalation_check(spark, d):
    """J6 on escalations: ratings outside 1 to 5 and references to missing tickets."""
    k = F.col("o_orderkey")
    e = A.read(spark, d, "orders").select(
        F.concat(F.lit("ESC-"), k.cast("string")).alias("escalation_id"),
        F.when(k % 5 != 0, F.concat(F.lit("IT-"), k.cast("string"))).alias("ticket_id"), F.when(k % 4 != 0, k % 7).alias("feedback_rating"))
    out = L.orphan_check(A.tickets(spark, d), A.logs(spark, d), escalations=e)
    return out.where(F.col("table_name") == "escalation_log")


@register("comment_notifications", """
SELECT t.ticket_id, 'comment' AS kind, 'agent' || CAST(l_suppkey % 9 AS VARCHAR) AS author, CAST(NULL AS VARCHAR) AS old_value,
       l_returnflag || l_linestatus AS new_value, l_shipdate AS created_at
FROM lineitem JOIN tickets t ON t.log_id = l_orderkey AND t.assigned_to = 'agent' || CAST(l_suppkey % 9 AS VARCHAR)""", ("tickets",))
def q_comment_notifications(spark, d):
    """Comments (line items) announced when their author is the ticket's assignee."""
    t = A.tickets(spark, d)
    comments = A.read(spark, d, "lineitem").join(t.select("ticket_id", "log_id"), F.col("l_orderkey") == F.col("log_id")).select(
        "ticket_id", F.concat(F.lit("agent"), (F.col("l_suppkey") % 9).cast("string")).alias("author"),
        F.concat("l_returnflag", "l_linestatus").alias("content"), F.col("l_shipdate").alias("created_at"))
    none = L.change_log(A.ticket_versions(spark, d)).where(F.lit(False))
    return L.notification_events(none, comments, t)
