"""DuckDB oracle text: the adapter mappings of ``sources/adapters.py`` as CTEs.

``with_inputs(body, "tickets", "logs")`` prefixes a query with exactly the
CTEs it needs (dependencies first). These strings are only ever run by the
external DuckDB checker; Spark never parses them.
"""

from __future__ import annotations

_SEG = "c.c_mktsegment"

ADAPTER_SQL = {
    "geo": """
SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "tickets": f"""
SELECT
  CASE {_SEG} WHEN 'MACHINERY' THEN 'IT-' WHEN 'BUILDING' THEN 'HR-' WHEN 'FURNITURE' THEN 'FIN-'
       ELSE 'GEN-' END || CAST(o.o_orderkey AS VARCHAR) AS ticket_id,
  c.c_name AS reporter_name,
  CAST(o.o_custkey AS VARCHAR) AS reporter_employee_id,
  g.r_name AS location,
  g.n_name AS department,
  CASE {_SEG} WHEN 'MACHINERY' THEN 'HARDWARE' WHEN 'AUTOMOBILE' THEN 'SOFTWARE'
       WHEN 'BUILDING' THEN 'ACCOUNT' WHEN 'FURNITURE' THEN 'EXPENSE' WHEN 'HOUSEHOLD' THEN 'OTHER'
       ELSE 'OTHER' END AS issue_type,
  CASE {_SEG} WHEN 'MACHINERY' THEN 'HARDWARE' WHEN 'AUTOMOBILE' THEN 'SOFTWARE'
       WHEN 'BUILDING' THEN 'ACCOUNT' WHEN 'FURNITURE' THEN 'EXPENSE' WHEN 'HOUSEHOLD' THEN 'OTHER'
       ELSE 'OTHER' END AS category,
  CASE WHEN substr(o.o_orderpriority, 1, 1) IN ('1', '2') THEN 'HIGH'
       WHEN substr(o.o_orderpriority, 1, 1) = '3' THEN 'MEDIUM' ELSE 'LOW' END AS urgency,
  CASE WHEN substr(o.o_orderpriority, 1, 1) IN ('1', '2') THEN 'HIGH'
       WHEN substr(o.o_orderpriority, 1, 1) = '3' THEN 'MEDIUM' ELSE 'LOW' END AS priority,
  lower({_SEG}) || ' request from ' || c.c_name AS summary,
  o.o_orderkey AS log_id,
  CAST(o.o_custkey AS VARCHAR) || '-' || strftime(o.o_orderdate, '%Y%m%d') AS thread_ts,
  CASE WHEN o.o_orderkey % 4 = 0 THEN 'slack' WHEN o.o_orderkey % 4 = 1 THEN 'web'
       WHEN o.o_orderkey % 4 = 2 THEN 'C' || CAST(o.o_custkey % 10 AS VARCHAR) END AS source_channel,
  CASE {_SEG} WHEN 'MACHINERY' THEN 'it' WHEN 'BUILDING' THEN 'hr' WHEN 'FURNITURE' THEN 'finance'
       ELSE 'general' END AS queue,
  CASE WHEN o.o_orderstatus = 'F' THEN (CASE WHEN o.o_orderkey % 5 = 0 THEN 'CLOSED' ELSE 'RESOLVED' END)
       WHEN o.o_orderstatus = 'O' THEN (CASE WHEN o.o_orderkey % 7 = 0 THEN 'ESCALATED'
            WHEN o.o_orderkey % 11 = 0 THEN 'HUMAN_REQUESTED' ELSE 'OPEN' END)
       ELSE 'IN_PROGRESS' END AS status,
  CASE WHEN o.o_orderkey % 3 <> 0 THEN 'agent' || CAST(o.o_custkey % 9 AS VARCHAR) END AS assigned_to,
  o.o_orderdate AS created_at,
  coalesce(CASE WHEN o.o_orderstatus = 'F' AND ls.last_ship >= o.o_orderdate THEN ls.last_ship END,
           o.o_orderdate) AS updated_at,
  CASE WHEN o.o_orderstatus = 'F' AND ls.last_ship >= o.o_orderdate THEN ls.last_ship END AS resolved_at
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN geo g ON c.c_nationkey = g.n_nationkey
LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey) ls
  ON o.o_orderkey = ls.l_orderkey""",
    "logs": """
SELECT
  event_id AS id,
  CASE event_type WHEN 'view' THEN 'INQUIRY' WHEN 'click' THEN 'AI_RESPONSE'
       WHEN 'purchase' THEN 'EVALUATION' WHEN 'error' THEN 'EVALUATION' ELSE 'INFO_RECEIVED' END AS log_type,
  CASE WHEN event_type IN ('click', 'purchase', 'error') THEN event_id - 1 END AS inquiry_id,
  'U' || CAST(user_id AS VARCHAR) AS user_id,
  'C' || CAST(user_id % 10 AS VARCHAR) AS channel_id,
  CASE WHEN event_type <> 'signup' THEN CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') END AS thread_ts,
  event_type || ' ' || props AS message,
  CASE user_id % 4 WHEN 0 THEN 'it' WHEN 1 THEN 'hr' WHEN 2 THEN 'finance' WHEN 3 THEN 'other' END AS category,
  CASE WHEN value >= 40 THEN 'HIGH' WHEN value >= 15 THEN 'MEDIUM' ELSE 'LOW' END AS priority,
  CASE WHEN event_type = 'click' THEN 'answer ' || props END AS ai_response_text,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS tokens_input,
  CAST(floor(value) AS INTEGER) AS tokens_output,
  CASE event_type WHEN 'purchase' THEN 'resolved' WHEN 'error' THEN 'escalate' END AS evaluation,
  CASE event_type WHEN 'purchase' THEN 'RESOLVED' WHEN 'error' THEN 'ESCALATED' ELSE 'OPEN' END AS status,
  ts AS created_at,
  CASE WHEN event_type = 'purchase' THEN ts END AS resolved_at
FROM events""",
    "conversation": """
SELECT
  conv_id * 1000 + turn AS id,
  'conv-' || CAST(conv_id AS VARCHAR) AS thread_ts,
  'U' || CAST(conv_id AS VARCHAR) AS user_id,
  CASE WHEN role = 'user' THEN 'INQUIRY' WHEN role = 'assistant' THEN 'AI_RESPONSE'
       ELSE 'INFO_RECEIVED' END AS log_type,
  CASE WHEN role <> 'assistant' THEN text END AS message,
  CASE WHEN role = 'assistant' THEN text END AS ai_response_text,
  'OPEN' AS status,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id * 60 + turn AS BIGINT)) AS created_at
FROM conversations""",
    "knowledge": """
SELECT
  d.doc_id AS id, d.text AS title, d.text AS content, d.lang AS category, d.source AS subcategory,
  d.lang || ', ' || d.source || ' ,' AS tags, 0 AS views, d.source AS author,
  lb.quality AS helpful, lb.toxic AS not_helpful,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id) AS created_at
FROM documents d LEFT JOIN labels lb ON d.doc_id = lb.doc_id""",
    "article_views": """
SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS article_id, ts AS viewed_at
FROM events WHERE event_type = 'view'""",
    "vectors": "SELECT vec_id, embedding, label FROM embeddings",
    "search_queries": "SELECT item_id AS query_id, text FROM benchmark",
    "assets": """
SELECT
  p_partkey AS id,
  'AST-' || lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(6, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0') AS asset_id,
  p_type AS asset_type, p_name AS name,
  CASE WHEN p_partkey % 4 <> 0 THEN 'Customer#' || lpad(CAST(p_partkey % 97 AS VARCHAR), 9, '0') END AS assignee,
  r_name AS location,
  CASE WHEN p_size % 10 = 0 THEN 'MAINTENANCE' WHEN p_size % 10 = 1 THEN 'RETIRED' ELSE 'ACTIVE' END AS status,
  p_brand AS notes
FROM part LEFT JOIN region ON p_size % 5 = r_regionkey""",
    "employees": """
SELECT 'E' || CAST(c_custkey AS VARCHAR) AS employee_id, c_name AS employee_name,
       g.n_name AS department, g.r_name AS location
FROM customer LEFT JOIN geo g ON c_nationkey = g.n_nationkey""",
    "ticket_versions": """
SELECT
  'U' || CAST(user_id AS VARCHAR) AS ticket_id, event_id AS version_id, ts AS changed_at,
  CASE event_type WHEN 'view' THEN 'OPEN' WHEN 'click' THEN 'IN_PROGRESS' WHEN 'purchase' THEN 'RESOLVED'
       WHEN 'error' THEN 'ESCALATED' WHEN 'signup' THEN 'OPEN' END AS status,
  'agent' || CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR) AS assigned_to,
  CASE WHEN event_type = 'purchase' THEN 'done' END AS resolution_notes,
  'agent' || CAST(event_id % 5 AS VARCHAR) AS author
FROM events""",
}

_DEPS = {"tickets": ["geo"], "employees": ["geo"]}


def with_inputs(body: str, *names: str) -> str:
    order: list[str] = []

    def add(n):
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({ADAPTER_SQL[n]}\n)" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
