"""Registered listing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketflow.operators import lifecycle as L
from ticketflow.operators import listing as S
from ticketflow.plans.registry import register
from ticketflow.sources import adapters as A

_Q = "customer#00000001"


@register("filter_search_tickets", f"""
SELECT ticket_id, status, urgency FROM tickets
WHERE status = 'OPEN' AND urgency = 'HIGH'
  AND (ticket_id ILIKE '%{_Q}%' OR reporter_name ILIKE '%{_Q}%' OR summary ILIKE '%{_Q}%'
       OR location ILIKE '%{_Q}%')""", ("tickets",))
def q_filter_search_tickets(spark, d):
    """F1 + F2: status/urgency equality plus a case-insensitive search over four columns."""
    t = S.filter_equal(A.tickets(spark, d), status="OPEN", urgency="HIGH", issue_type="")
    t = S.search_any(t, _Q, ["ticket_id", "reporter_name", "summary", "location"])
    return t.select("ticket_id", "status", "urgency")


@register("search_wildcard", """
SELECT ticket_id FROM tickets
WHERE ticket_id ILIKE '%mach_nery%' OR reporter_name ILIKE '%mach_nery%' OR summary ILIKE '%mach_nery%'
   OR location ILIKE '%mach_nery%'""", ("tickets",))
def q_search_wildcard(spark, d):
    """F2 quirk: '_' in the search term acts as a wildcard (matches 'machinery')."""
    t = S.search_any(A.tickets(spark, d), "mach_nery", ["ticket_id", "reporter_name", "summary", "location"])
    return t.select("ticket_id")


@register("search_escaped", """
SELECT ticket_id FROM tickets
WHERE replace(summary, ' ', CASE WHEN log_id % 3 = 0 THEN '_' WHEN log_id % 3 = 1 THEN '%' ELSE ' ' END) ILIKE '%request\\_from%' ESCAPE '\\'""",
          ("tickets",))
def q_search_escaped(spark, d):
    """F2 with escape=True: '_' is literal, so 'request_from' finds the third of the summaries that are
    written with it, and neither those with spaces nor those with '%'."""
    mark = F.when(F.col("log_id") % 3 == 0, "_").when(F.col("log_id") % 3 == 1, "%").otherwise(" ")
    t = A.tickets(spark, d).withColumn("summary", F.replace("summary", F.lit(" "), mark))
    return S.search_any(t, "request_from", ["summary", "location"], escape=True).select("ticket_id")


@register("paginate_tickets", """
SELECT ticket_id, created_at FROM tickets WHERE urgency = 'HIGH'
ORDER BY created_at DESC, ticket_id DESC LIMIT 20 OFFSET 40""", ("tickets",))
def q_paginate_tickets(spark, d):
    """O1 page 3 of 20, newest first with the ticket id tie-breaker."""
    rows, _ = S.paginate(S.filter_equal(A.tickets(spark, d), urgency="HIGH"), page=3, limit=20)
    return rows.select("ticket_id", "created_at")


@register("paginate_meta", """
SELECT count(*) AS total, 3 AS page, 20 AS "limit", CAST(ceil(count(*) / 20) AS BIGINT) AS total_pages
FROM tickets WHERE urgency = 'HIGH'""", ("tickets",))
def q_paginate_meta(spark, d):
    """O1 page meta: total and ceil(total / limit)."""
    _, meta = S.paginate(S.filter_equal(A.tickets(spark, d), urgency="HIGH"), page=3, limit=20)
    return meta


@register("page_after", """
SELECT ticket_id, created_at FROM tickets
WHERE created_at < TIMESTAMP '1998-01-01 00:00:00'
   OR (created_at = TIMESTAMP '1998-01-01 00:00:00' AND ticket_id < 'HR-5000')
ORDER BY created_at DESC, ticket_id DESC LIMIT 20""", ("tickets",))
def q_page_after(spark, d):
    """O1 keyset page: the 20 tickets after (1998-01-01, HR-5000) in newest-first order."""
    out = S.page_after(A.tickets(spark, d), "1998-01-01 00:00:00", "HR-5000", 20)
    return out.select("ticket_id", "created_at")


@register("log_order_thread", """
SELECT id, thread_ts, created_at FROM logs WHERE thread_ts LIKE '%10-2024010%'
ORDER BY created_at ASC, id ASC LIMIT 100""", ("logs",))
def q_log_order_thread(spark, d):
    """F3 + O3: ticket-id substring match on thread_ts, ascending, LIMIT 100."""
    return S.log_order(A.logs(spark, d), ticket_id="10-2024010").select("id", "thread_ts", "created_at")


@register("log_order_latest", """
SELECT id, log_type, created_at FROM logs WHERE log_type = 'INQUIRY'
ORDER BY created_at DESC, id DESC LIMIT 100""", ("logs",))
def q_log_order_latest(spark, d):
    """O3 newest 100 inquiries."""
    return S.log_order(A.logs(spark, d), log_type="INQUIRY").select("id", "log_type", "created_at")


_HIST = """
v AS (SELECT *, lag(status) OVER w AS o_status, row_number() OVER w AS pos
      FROM ticket_versions WINDOW w AS (PARTITION BY ticket_id ORDER BY changed_at, version_id)),
h AS (SELECT ticket_id, changed_at AS created_at, author, version_id FROM v
      WHERE pos > 1 AND o_status IS DISTINCT FROM status)"""


def _history(spark, d):
    return L.change_log(A.ticket_versions(spark, d), fields=["status"]).withColumnRenamed("version_id", "id")


@register("audit_page", "WITH " + _HIST + """
SELECT ticket_id, author, created_at, version_id AS id FROM h WHERE author = 'agent3'
ORDER BY created_at DESC, version_id DESC LIMIT 100""", ("ticket_versions",))
def q_audit_page(spark, d):
    """O4 newest 100 status changes by one author (action filter 'all' = none)."""
    return S.audit_page(_history(spark, d), action="all", author="agent3").select(
        "ticket_id", "author", "created_at", "id")


@register("distinct_authors", "WITH " + _HIST + "\nSELECT DISTINCT author FROM h", ("ticket_versions",))
def q_distinct_authors(spark, d):
    """A13 sorted distinct authors of the change log."""
    return S.distinct_authors(_history(spark, d))


@register("latest_tickets", """
SELECT ticket_id, reporter_name, issue_type, urgency, status, summary, created_at FROM tickets
ORDER BY created_at DESC, ticket_id DESC LIMIT 20""", ("tickets",))
def q_latest_tickets(spark, d):
    """O5 the latest 20 tickets, 7 columns."""
    return S.latest_tickets(A.tickets(spark, d), 20)


@register("ordered_assets", "SELECT asset_id, asset_type, status FROM assets ORDER BY asset_id", ("assets",))
def q_ordered_assets(spark, d):
    """O2 assets by asset_id with the listing filters type='all' and status='all' (no-ops)."""
    a = S.filter_equal(A.assets(spark, d), sentinel="all", asset_type="all", status="all")
    return S.ordered_list(a, "asset_id").select("asset_id", "asset_type", "status")


@register("active_tickets", """
SELECT ticket_id, status FROM tickets WHERE status IN ('OPEN', 'IN_PROGRESS', 'HUMAN_REQUESTED')""",
          ("tickets",))
def q_active_tickets(spark, d):
    """F6 active tickets."""
    return S.active_tickets(A.tickets(spark, d)).select("ticket_id", "status")


@register("point_lookup", """
SELECT ticket_id, status FROM tickets
WHERE ticket_id IN (SELECT 'GEN-' || CAST(inquiry_id AS VARCHAR) FROM logs WHERE log_type = 'EVALUATION')""",
          ("tickets", "logs"))
def q_point_lookup(spark, d):
    """F8 batch point lookup: tickets whose id is in a list derived from evaluations (semi join)."""
    ids = A.logs(spark, d).where(F.col("log_type") == "EVALUATION").select(
        F.concat(F.lit("GEN-"), F.col("inquiry_id").cast("string")).alias("ticket_id"))
    return S.point_lookup(A.tickets(spark, d), ids).select("ticket_id", "status")


@register("all_tickets", """
SELECT ticket_id, 'it' AS queue, issue_type, department FROM tickets WHERE queue IN ('it', 'general')
UNION ALL SELECT ticket_id, 'hr', issue_type, NULL FROM tickets WHERE queue = 'hr'
UNION ALL SELECT ticket_id, 'finance', issue_type, department FROM tickets WHERE queue = 'finance'""",
          ("tickets",))
def q_all_tickets(spark, d):
    """U1 helpdesk + hr + finance tables as one (finance writes request_type)."""
    t = A.tickets(spark, d)
    helpdesk = t.where(F.col("queue").isin("it", "general")).select("ticket_id", "issue_type", "department")
    hr = t.where(F.col("queue") == "hr").select("ticket_id", "issue_type")
    fin = t.where(F.col("queue") == "finance").select("ticket_id", F.col("issue_type").alias("request_type"),
                                                       "department")
    return S.all_tickets(helpdesk, hr, fin).select("ticket_id", "queue", "issue_type", "department")


@register("client_search", """
SELECT doc_id FROM documents
WHERE coalesce(contains(lower(source), 'rc1'), FALSE) OR coalesce(contains(lower(text), 'rc1'), FALSE)""")
def q_client_search(spark, d):
    """F4 lower-case contains over title or a non-null description."""
    docs = A.read(spark, d, "documents").select("doc_id", F.col("source").alias("title"),
                                                F.col("text").alias("description"))
    return S.client_search(docs, "RC1").select("doc_id")


_TERM = """CASE item_id % 10 WHEN 0 THEN substr(w, 1, 2) || '_' || substr(w, 4) WHEN 1 THEN substr(w, 1, 2) WHEN 2 THEN substr(w, 1, 3) || '%' || right(w, 2) ELSE w END"""


@register("search_many_terms", f"""
WITH t AS (SELECT item_id, {_TERM} AS term FROM (
  SELECT item_id, list_reduce(regexp_split_to_array(text, '[^A-Za-z]+'), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) AS w FROM benchmark) WHERE w <> '')
SELECT item_id, doc_id FROM t, documents WHERE term <> '' AND (text ILIKE '%' || term || '%' OR source ILIKE '%' || term || '%')""")
def q_search_many_terms(spark, d):
    """F2 for a batch of terms: the longest word of every benchmark item, some cut to two letters or with
    wildcards, searched in every document."""
    words = F.split("text", "[^A-Za-z]+")
    longest = F.aggregate(words, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    k, w = F.col("item_id") % 10, F.col("w")
    term = (F.when(k == 0, F.concat(F.substring(w, 1, 2), F.lit("_"), w.substr(F.lit(4), F.length(w)))).when(k == 1, F.substring(w, 1, 2))
            .when(k == 2, F.concat(F.substring(w, 1, 3), F.lit("%"), F.right(w, F.lit(2)))).otherwise(w))
    terms = A.read(spark, d, "benchmark").select("item_id", longest.alias("w")).where("w <> ''").select("item_id", term.alias("term"))
    return S.search_many(A.read(spark, d, "documents"), terms, ["text", "source"], "doc_id", "item_id")
