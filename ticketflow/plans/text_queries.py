"""Registered text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketflow.functions import agent, text
from ticketflow.operators import entities
from ticketflow.plans.registry import register, round_doubles
from ticketflow.sources import adapters as A


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SP = text.JS_SPACE
class _Trim:
    """SQL for JS trim of an expression (the pattern's braces rule out str.format)."""

    def format(self, x: str) -> str:
        return "regexp_replace(" + x + ", " + _lit(f"^{_SP}+|{_SP}+\\z") + ", '', 'g')"


_TRIM = _Trim()


def _sql_any(col: str, patterns) -> str:
    if not patterns:
        return "FALSE"
    return " OR ".join(f"regexp_matches({col}, {_lit(text.java_regex(p, f))})" for p, f in patterns)


def _sql_skip(col: str, variant: str) -> str:
    thanks, infos, short = text.SKIP_VARIANTS[variant]
    m = _TRIM.format(x=f"coalesce({col}, '')")
    out = f"CASE WHEN {_sql_any(m, thanks)} THEN 'thank_you'"
    if infos:
        out += f" WHEN {_sql_any(m, infos)} THEN 'info_only'"
    if short:
        clean = _TRIM.format(x=f"regexp_replace({m}, '[\\n\\r]', ' ', 'g')")
        out += (f" WHEN length({clean}) <= {text.SHORT_DATA_MAX} AND "
                f"regexp_matches({clean}, {_lit(text.js(text.SHORT_DATA_PATTERN))}) THEN 'short_data'")
    return out + " END"


@register("skip_reason", f"""
SELECT conv_id, turn, {_sql_skip('text', 'general')} AS reason_general,
       {_sql_skip('text', 'finance')} AS reason_finance, {_sql_skip('text', 'it')} AS reason_it
FROM conversations""")
def q_skip_reason(spark, d):
    """E5 skip classification of every conversation message, three queue variants."""
    cv = A.read(spark, d, "conversations")
    return cv.select("conv_id", "turn", text.skip_reason("text", "general").alias("reason_general"),
                     text.skip_reason("text", "finance").alias("reason_finance"),
                     text.skip_reason("text", "it").alias("reason_it"))


@register("skip_reason_documents", f"""
SELECT doc_id, {_sql_skip('text', 'general')} AS reason_general FROM documents""")
def q_skip_reason_documents(spark, d):
    """E5 over whole documents (long, multi-line texts)."""
    return A.read(spark, d, "documents").select("doc_id", text.skip_reason("text", "general").alias("reason_general"))


_FIT_SQL = f"""
WITH m AS (
  SELECT doc_id, 'C' || lang AS channel_id, CAST(NULL AS VARCHAR) AS thread_ts, 'U' || CAST(doc_id AS VARCHAR) AS user_id,
         source AS user_name,
         {_TRIM.format(x="regexp_replace(coalesce(text, ''), '<@[A-Z0-9]+>', '', 'g')")} AS message,
         CAST(doc_id AS VARCHAR) AS event_ts, 'it' AS category
  FROM documents),
c AS (
  SELECT doc_id, list_transform(range(0, CAST(ceil(log2(length(message) + 1)) AS BIGINT) + 2),
      lambda k: to_json({{'channel_id': channel_id, 'thread_ts': thread_ts, 'user_id': user_id,
                         'user_name': user_name,
                         'message': substr(message, 1, CAST(floor(length(message) / pow(2, k)) AS BIGINT)),
                         'event_ts': event_ts, 'category': category}})::VARCHAR) AS cands
  FROM m)
SELECT doc_id, coalesce(list_filter(cands, lambda v: strlen(v) <= 2000)[1], cands[-1]) AS value,
       strlen(coalesce(list_filter(cands, lambda v: strlen(v) <= 2000)[1], cands[-1])) AS value_bytes
FROM c"""


@register("fit_bytes", _FIT_SQL)
def q_fit_bytes(spark, d):
    """E4 + E6: mention-stripped message of every document, button JSON halved to <= 2000 bytes."""
    docs = A.read(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("C"), F.col("lang")).alias("channel_id"),
        F.lit(None).cast("string").alias("thread_ts"),
        F.concat(F.lit("U"), F.col("doc_id").cast("string")).alias("user_id"),
        F.col("source").alias("user_name"), text.strip_mentions("text").alias("message"),
        F.col("doc_id").cast("string").alias("event_ts"), F.lit("it").alias("category"))
    v = text.fit_bytes(docs).select("doc_id", "value")
    return v.select("doc_id", "value", F.octet_length("value").cast("long").alias("value_bytes"))


_FEEDBACK_BODY = """
b AS (
  SELECT id,
    CASE WHEN id % 11 = 0 THEN NULL
         WHEN id % 7 = 0 THEN '{bad json'
         ELSE to_json({'log_id': inquiry_id, 'ticket_id': CASE WHEN id % 2 = 0 THEN 'GEN-' || CAST(id AS VARCHAR) END,
                       'category': CASE WHEN id % 3 = 0 THEN NULL ELSE category END})::VARCHAR END AS value,
    CAST(id AS VARCHAR) AS log_id, CASE WHEN id % 5 = 0 THEN 'IT-' || CAST(id AS VARCHAR) END AS ticket_id,
    CASE WHEN id % 4 = 0 THEN NULL ELSE 'hr' END AS category,
    thread_ts, CASE WHEN id % 6 = 0 THEN 'thanks' END AS comment
  FROM logs WHERE log_type = 'EVALUATION')"""


def _nz(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL AND {x} <> '' THEN {x} END"


@register("parse_feedback", "WITH " + _FEEDBACK_BODY + f""",
p AS (SELECT *, try(json(coalesce(value, '{{}}'))) IS NULL AS bad,
             try(json_extract_string(coalesce(value, '{{}}'), '$.log_id')) AS v_log,
             try(json_extract_string(coalesce(value, '{{}}'), '$.ticket_id')) AS v_ticket,
             try(json_extract_string(coalesce(value, '{{}}'), '$.category')) AS v_cat FROM b)
SELECT id,
  coalesce({_nz("CASE WHEN bad THEN log_id ELSE v_log END")}, {_nz("log_id")}) AS log_id,
  coalesce({_nz("CASE WHEN bad THEN ticket_id ELSE v_ticket END")}, {_nz("ticket_id")}) AS ticket_id,
  coalesce({_nz("CASE WHEN bad THEN coalesce(" + _nz("category") + ", 'it') ELSE v_cat END")},
           {_nz("category")}, 'it') AS category,
  coalesce({_nz("thread_ts")}, '') AS thread_ts, coalesce({_nz("comment")}, '') AS comment
FROM p""", ("logs",))
def q_parse_feedback(spark, d):
    """E11 feedback payloads (valid, malformed and missing value JSON) parsed with fallbacks."""
    lg = A.logs(spark, d).where(F.col("log_type") == "EVALUATION")
    i = F.col("id")
    value = (F.when(i % 11 == 0, F.lit(None).cast("string")).when(i % 7 == 0, F.lit("{bad json"))
             .otherwise(F.to_json(F.struct(
                 F.col("inquiry_id").alias("log_id"),
                 F.when(i % 2 == 0, F.concat(F.lit("GEN-"), i.cast("string"))).alias("ticket_id"),
                 F.when(i % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("category")).alias("category")))))
    body = lg.select("id", value.alias("value"), i.cast("string").alias("log_id"),
                     F.when(i % 5 == 0, F.concat(F.lit("IT-"), i.cast("string"))).alias("ticket_id"),
                     F.when(i % 4 == 0, F.lit(None).cast("string")).otherwise(F.lit("hr")).alias("category"),
                     "thread_ts", F.when(i % 6 == 0, F.lit("thanks")).alias("comment"))
    return body.select("id", *text.parse_feedback())


@register("route_messages", """
WITH ev AS (
  SELECT event_id,
    CASE WHEN event_type = 'signup' THEN 'app_mention' ELSE 'message' END AS type,
    CASE WHEN event_type = 'error' THEN 'message_changed' END AS subtype,
    CASE WHEN user_id % 13 = 0 THEN 'B1' END AS bot_id,
    CASE WHEN user_id % 5 = 0 THEN 'im' ELSE 'channel' END AS channel_type,
    CASE WHEN event_type IN ('click', 'purchase') THEN CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d')
         WHEN event_type = 'view' AND event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) END AS thread_ts,
    CAST(event_id AS VARCHAR) AS ts,
    CASE WHEN event_id % 17 = 0 THEN 1 END AS retry_num
  FROM events)
SELECT event_id,
  CASE WHEN retry_num IS NOT NULL THEN 'drop' WHEN type = 'app_mention' THEN 'selection'
       WHEN bot_id IS NOT NULL AND bot_id <> '' THEN 'drop' WHEN subtype IS NOT NULL AND subtype <> '' THEN 'drop'
       WHEN channel_type = 'im' THEN 'selection'
       WHEN thread_ts IS NOT NULL AND thread_ts <> '' AND thread_ts <> coalesce(ts, '') THEN 'process'
       ELSE 'drop' END AS route
FROM ev""")
def q_route_messages(spark, d):
    """F9 routing of inbound chat events (retries, bots, edits, DMs, mentions, thread replies)."""
    e = A.read(spark, d, "events")
    et = F.col("event_type")
    ev = e.select(
        "event_id",
        F.when(et == "signup", "app_mention").otherwise("message").alias("type"),
        F.when(et == "error", "message_changed").alias("subtype"),
        F.when(F.col("user_id") % 13 == 0, "B1").alias("bot_id"),
        F.when(F.col("user_id") % 5 == 0, "im").otherwise("channel").alias("channel_type"),
        F.when(et.isin("click", "purchase"), F.concat(F.col("user_id").cast("string"), F.lit("-"),
                                                      F.date_format("ts", "yyyyMMdd")))
         .when((et == "view") & (F.col("event_id") % 3 == 0), F.col("event_id").cast("string")).alias("thread_ts"),
        F.col("event_id").cast("string").alias("ts"),
        F.when(F.col("event_id") % 17 == 0, F.lit(1)).alias("retry_num"))
    return ev.select("event_id", text.route_messages().alias("route"))


@register("tag_counts", f"""
SELECT tag, count(*) AS articles FROM (
  SELECT unnest(string_split(tags, ',')) AS raw FROM knowledge) t,
  LATERAL (SELECT {_TRIM.format(x="raw")} AS tag)
GROUP BY tag""", ("knowledge",))
def q_tag_counts(spark, d):
    """E12 tags split on commas and trimmed, counted per tag."""
    k = A.knowledge(spark, d)
    return (k.select(F.explode(text.split_tags("tags")).alias("tag"))
            .groupBy("tag").agg(F.count(F.lit(1)).alias("articles")))


@register("flatten_knowledge", """
SELECT doc_id, text AS title,
       '【回答】' || chr(10) || text || chr(10) || chr(10) || '【解決手順】' || chr(10)
         || array_to_string(string_split(text, chr(10)), chr(10)) AS content,
       lang AS category, source AS tags, 'ヘルプデスク' AS author
FROM documents""")
def q_flatten_knowledge(spark, d):
    """S9 FAQ records (question, answer, JSON steps) flattened into articles."""
    faq = A.read(spark, d, "documents").select(
        "doc_id", F.col("text").alias("question"), F.col("text").alias("answer"),
        F.to_json(F.split(F.col("text"), "\n")).alias("resolution_steps"),
        F.col("lang").alias("category"), F.col("source").alias("keywords"))
    return faq.select("doc_id", *text.flatten_knowledge_columns())


@register("asset_search_text", """
SELECT asset_id, 'アセットID: ' || asset_id || ' ' || 'タイプ: ' || asset_type || ' ' ||
       'デバイス名: ' || coalesce(name, '') || ' ' || 'メーカー: ' || coalesce(notes, '') || ' ' ||
       'モデル: ' || '' || ' ' || '担当者: ' || coalesce(assignee, '未割当') || ' ' ||
       '部署: ' || '不明' || ' ' || '場所: ' || coalesce(location, '不明') || ' ' || '備考: ' || '' AS search_text
FROM assets WHERE status = 'ACTIVE'""", ("assets",))
def q_asset_search_text(spark, d):
    """P5 + F5: labelled search text of ACTIVE assets."""
    a = A.assets(spark, d).where(F.col("status") == "ACTIVE").select(
        "asset_id", "asset_type", F.col("name").alias("asset_name"), F.col("notes").alias("manufacturer"),
        F.lit(None).cast("string").alias("model"), F.col("assignee").alias("assigned_to"),
        F.lit(None).cast("string").alias("department"), "location", F.lit(None).cast("string").alias("notes"))
    return a.select("asset_id", text.asset_search_text().alias("search_text"))


@register("kb_search_text", """
SELECT id, '質問: ' || title || ' ' || 'カテゴリ: ' || category || ' ' || coalesce(subcategory, '') || ' ' ||
       '回答: ' || content || ' ' || 'キーワード: ' || coalesce(tags, '') AS search_text
FROM knowledge""", ("knowledge",))
def q_kb_search_text(spark, d):
    """P5 knowledge search text over every article (whole texts)."""
    k = A.knowledge(spark, d).select("id", F.col("title").alias("question"), "category", "subcategory",
                                     F.col("content").alias("answer"), F.col("tags").alias("keywords"))
    return k.select("id", text.kb_search_text().alias("search_text"))


def _kw_sql(col, words):
    """A keyword occurs: Latin ones as whole words, others anywhere."""
    return "(" + " OR ".join(
        f"regexp_matches(lower({col}), {_lit('(^|[^a-z0-9])' + w + '($|[^a-z0-9])')})" if w.isascii() else f"contains({col}, {_lit(w)})"
        for w in words) + ")"


_TRIAGE_CAT = " ".join(f"WHEN {_kw_sql('m', w)} THEN '{k}'" for k, w in text.TRIAGE_CATEGORY.items())


@register("triage", f"""
WITH t AS (SELECT conv_id, turn, {_TRIM.format(x="coalesce(text, '')")} AS m FROM conversations WHERE role = 'user')
SELECT conv_id, turn,
  CASE WHEN {_kw_sql('m', text.TRIAGE_URGENCY['HIGH'])} THEN 'HIGH'
       WHEN {_kw_sql('m', text.TRIAGE_URGENCY['MEDIUM'])} THEN 'MEDIUM' ELSE 'LOW' END AS urgency,
  CASE {_TRIAGE_CAT} ELSE 'OTHER' END AS category,
  substr(m, 1, 50) AS summary,
  list_filter(list_transform(regexp_split_to_array(m, '[。\\n]|\\. '), lambda s: {_TRIM.format(x="s")}),
              lambda s: s <> '') AS details
FROM t""")
def q_triage(spark, d):
    """E16 (re-aimed) keyword triage of every user message: urgency, category, summary, details."""
    cv = A.read(spark, d, "conversations").where(F.col("role") == "user")
    return cv.select("conv_id", "turn", *text.triage("text"))


# --------------------------------------------------------------- E10 round trip

def _agent_inputs(spark, d):
    """Agent response JSON per assistant turn, assembled from conversation columns.

    Every 5th turn carries malformed JSON, every 5th+3 no fenced block, every
    7th a fenced block that is invalid JSON (falls back to a raw match).
    """
    cv = A.read(spark, d, "conversations").where(F.col("role") == "assistant")
    k = F.col("conv_id") * 10 + F.col("turn")
    cat = F.try_element_at(F.array(*[F.lit(x) for x in ("HARDWARE", "SOFTWARE", "ACCOUNT", "OTHER")]),
                       (k % 4 + 1).cast("int"))
    pri = F.when(k % 3 == 0, "HIGH").when(k % 3 == 1, "LOW").otherwise("")
    inner = F.to_json(F.struct(cat.alias("category"), pri.alias("priority"),
                               F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("summary"),
                               (k % 2 == 0).alias("needs_escalation"),
                               F.when(k % 2 == 0, "IT_SUPPORT").alias("escalationTeam"),
                               F.split(F.col("text"), "\n").alias("resolution_steps")))
    body = (F.when(k % 5 == 3, F.col("text"))
            .when(k % 7 == 0, F.concat(F.lit("see\n```json\n{broken\n```\n--- "), F.col("text")))
            .otherwise(F.concat(F.lit("ok\n```json\n"), inner, F.lit("\n```\n--- "), F.col("text"))))
    hit = F.struct(F.concat(F.lit("KB-"), F.col("conv_id").cast("string")).alias("id"),
                   F.lit(None).cast("string").alias("kb_id"),
                   F.format_string("%.2f", (k % 100) / 100.0).alias("@CONFIDENCE_SCORE"),
                   F.col("text").alias("text"))
    tool = F.struct(F.array(F.struct(F.struct(F.array(hit).alias("search_results")).alias("json")))
                    .alias("content"))
    content = F.array(
        F.struct(F.lit("tool_result").alias("type"), F.lit(None).cast("string").alias("text"),
                 tool.alias("tool_result")),
        F.struct(F.lit("text").alias("type"), body.alias("text"),
                 F.lit(None).cast(tool_type()).alias("tool_result")))
    usage = F.struct(F.array(F.struct(
        F.struct(F.char_length("text").cast("long").alias("total")).alias("input_tokens"),
        F.struct((k % 50).cast("long").alias("total")).alias("output_tokens"),
        F.lit("model-a").alias("model_name"))).alias("tokens_consumed")).alias("usage")
    js = F.to_json(F.struct(content.alias("content"), F.struct(usage).alias("metadata")))
    resp = F.when(k % 5 == 4, F.substring(js, 1, 40)).otherwise(js)
    return cv.select("conv_id", "turn", resp.alias("response"))


def tool_type():
    return ("struct<content: array<struct<json: struct<search_results: array<struct<id: string, "
            "kb_id: string, `@CONFIDENCE_SCORE`: string, text: string>>>>>>")


_K = "(conv_id * 10 + turn)"
_REPLY = _TRIM.format(x="regexp_replace(" + _TRIM.format(x="chr(10) || '--- ' || text") +
                      ", '^[-" + _SP[1:-1] + "]+', '', 'g')")


@register("parse_agent_response", f"""
WITH c AS (SELECT conv_id, turn, text, {_K} AS k FROM conversations WHERE role = 'assistant'),
e AS (SELECT *, k % 5 = 4 AS err, k % 5 = 3 AS plain, k % 5 NOT IN (3, 4) AND k % 7 = 0 AS broken,
             ['HARDWARE', 'SOFTWARE', 'ACCOUNT', 'OTHER'][k % 4 + 1] AS cat,
             CASE WHEN k % 3 = 0 THEN 'HIGH' WHEN k % 3 = 1 THEN 'LOW' ELSE '' END AS pri FROM c),
f AS (SELECT *,
        CASE WHEN broken THEN 'see' || chr(10) || '```json' || chr(10) || '{{broken' || chr(10) || '```'
             ELSE 'ok' || chr(10) || '```json' || chr(10) ||
                  (CASE WHEN k % 2 = 0
                        THEN to_json({{'category': cat, 'priority': pri, 'summary': 'turn ' || CAST(turn AS VARCHAR),
                                      'needs_escalation': true, 'escalationTeam': 'IT_SUPPORT',
                                      'resolution_steps': string_split(text, chr(10))}})
                        ELSE to_json({{'category': cat, 'priority': pri, 'summary': 'turn ' || CAST(turn AS VARCHAR),
                                      'needs_escalation': false, 'resolution_steps': string_split(text, chr(10))}})
                   END)::VARCHAR || chr(10) || '```' END || chr(10) || '--- ' || text AS content
      FROM e)
SELECT conv_id, turn,
  CASE WHEN err THEN 'ERROR' WHEN plain OR broken THEN 'OTHER' ELSE cat END AS category,
  CASE WHEN err THEN 'HIGH' WHEN plain OR broken THEN 'MEDIUM' ELSE coalesce(nullif(pri, ''), 'MEDIUM') END
    AS priority,
  CASE WHEN err THEN 'エラーが発生しました' WHEN plain OR broken THEN '問い合わせ内容'
       ELSE 'turn ' || CAST(turn AS VARCHAR) END AS summary,
  CASE WHEN err THEN '申し訳ありません。処理中にエラーが発生しました。担当者に連絡いたします。'
       WHEN plain THEN text ELSE coalesce(nullif({_REPLY}, ''), content) END AS ai_response_text,
  CASE WHEN err THEN TRUE WHEN plain OR broken THEN FALSE ELSE k % 2 = 0 END AS needs_escalation,
  CASE WHEN err THEN 'IT_SUPPORT' WHEN plain OR broken THEN NULL WHEN k % 2 = 0 THEN 'IT_SUPPORT' END
    AS escalation_team,
  CASE WHEN err OR plain OR broken THEN CAST([] AS VARCHAR[]) ELSE string_split(text, chr(10)) END
    AS resolution_steps,
  CASE WHEN err THEN '' ELSE 'KB-' || CAST(conv_id AS VARCHAR) END AS matched_kb_ids,
  CASE WHEN err THEN NULL ELSE round(CAST(printf('%.2f', (k % 100) / 100.0) AS DOUBLE), 6) END AS top_score,
  CASE WHEN err THEN 0 ELSE CAST(length(text) AS INTEGER) END AS tokens_input,
  CASE WHEN err THEN 0 ELSE CAST(k % 50 AS INTEGER) END AS tokens_output,
  CASE WHEN err THEN 'unknown' ELSE 'model-a' END AS model_name,
  err AS parse_error,
  CASE WHEN NOT err AND NOT (CASE WHEN plain OR broken THEN FALSE ELSE k % 2 = 0 END)
            AND CAST(printf('%.2f', (k % 100) / 100.0) AS DOUBLE) >= 0.6 THEN 'answer' ELSE 'escalate' END AS gate
FROM f""")
def q_parse_agent_response(spark, d):
    """E10 + F10: agent JSON (fenced, raw, broken, malformed) parsed back to log columns, then the
    confidence gate on the top search score. Reply text with an empty tail keeps the content."""
    out = agent.parse_agent_response(_agent_inputs(spark, d)).drop("response")
    top = F.try_element_at(F.col("confidence_scores"), F.lit(1))["score"]
    out = out.select("*", top.alias("top_score"),
                     text.confidence_gate(~F.col("needs_escalation") & ~F.col("parse_error"), top).alias("gate"))
    return round_doubles(out.drop("confidence_scores"))


@register("parse_agent_variant", f"""
WITH c AS (SELECT conv_id, turn, text, {_K} AS k FROM conversations WHERE role = 'assistant'),
e AS (SELECT *, k % 5 = 4 AS err, k % 5 = 3 AS plain FROM c)
SELECT conv_id, turn, 'HR' AS category, 'MEDIUM' AS priority,
  CASE WHEN err THEN {_lit(agent.VARIANT_ERROR_SUMMARY)} ELSE substr(coalesce(text, ''), 1, {agent.SNIPPET}) END AS summary,
  CASE WHEN err THEN {_lit(agent.VARIANT_ERROR_REPLY)} WHEN plain THEN text ELSE coalesce(nullif({_REPLY}, ''), text) END AS ai_response_text,
  err AS parse_error
FROM e""")
def q_parse_agent_variant(spark, d):
    """E10, queue variant (HR): fixed category and priority, the message's first 100 characters as summary."""
    x = _agent_inputs(spark, d).join(A.read(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("message")),
                                     ["conv_id", "turn"])
    return agent.parse_agent_response(x, message="message", variant="hr").drop("response", "message")


@register("message_snippets", """
SELECT conv_id, turn, substr(coalesce(text, ''), 1, 100) AS summary, substr(coalesce(text, ''), 1, 2900) AS reply,
       replace(replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'),
               chr(9), '\\t') AS escaped
FROM conversations""")
def q_message_snippets(spark, d):
    """E7 summary (first 100) and reply (first 2900) cuts, E8 JSON-text escaping of every turn."""
    cv = A.read(spark, d, "conversations")
    return cv.select("conv_id", "turn", text.truncate("text", 100).alias("summary"),
                     text.truncate("text", 2900).alias("reply"), text.escape_json_text("text").alias("escaped"))


_NAMED = """
m AS (SELECT ticket_id, list_filter(regexp_split_to_array(lower(message), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS t FROM (
  SELECT ticket_id, CASE log_id % 5 WHEN 0 THEN summary WHEN 1 THEN summary || ' / ' || department || ', ' || location
    WHEN 2 THEN 'printer in ' || location || ' is down' WHEN 3 THEN 'help! ' || reporter_name || ': (' || department || ')' ELSE 'nobody knows' END AS message FROM tickets)),
grams AS (SELECT ticket_id, n, i, array_to_string(t[i:i + n - 1], ' ') AS gram FROM (
  SELECT ticket_id, n, t, unnest(range(1, len(t) - n + 2)) AS i FROM m, (SELECT unnest([1, 2, 3]) AS n) WHERE len(t) >= n))"""


def _named_sql(column: str, source: str) -> str:
    return f"""
{column}_d AS (SELECT array_to_string(list_filter(regexp_split_to_array(lower({source}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''), ' ') AS gram, min({source}) AS name
  FROM employees WHERE {source} IS NOT NULL GROUP BY 1),
{column}_m AS (SELECT ticket_id, arg_min(name, (-n, i, name)) AS name FROM grams JOIN {column}_d USING (gram) GROUP BY ticket_id)"""


@register("triage_names", "WITH " + ",".join([_NAMED.strip(), _named_sql("reporter", "employee_name"), _named_sql("dept", "department"), _named_sql("loc", "location")]) + """
SELECT m.ticket_id, r.name AS reporter_name, coalesce(dm.name, e.department) AS department, coalesce(lm.name, e.location) AS location
FROM m LEFT JOIN reporter_m r USING (ticket_id) LEFT JOIN dept_m dm USING (ticket_id) LEFT JOIN loc_m lm USING (ticket_id)
LEFT JOIN employees e ON r.name = e.employee_name""", ("tickets", "employees"))
def q_triage_names(spark, d):
    """Reporter, department and location named in a message, the longest match of each; what a
    message doesn't name is the reporter's own."""
    k = F.col("log_id") % 5
    message = (F.when(k == 0, F.col("summary")).when(k == 1, F.concat("summary", F.lit(" / "), "department", F.lit(", "), "location"))
               .when(k == 2, F.concat(F.lit("printer in "), "location", F.lit(" is down")))
               .when(k == 3, F.concat(F.lit("help! "), "reporter_name", F.lit(": ("), "department", F.lit(")"))).otherwise("nobody knows"))
    return entities.extract_people_and_places(A.tickets(spark, d).select("ticket_id", message.alias("message")), A.employees(spark, d), "ticket_id", "message")


@register("triage_learned")
def q_triage_learned(spark, d):
    """E16 with a learned category: an article's category from its text, learned without the rows whose
    crc32(id) mod 4 is 2; tested by the accuracy on these."""
    k = A.knowledge(spark, d).select("id", "content", "category")
    held_out = F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2
    predict = entities.learn_category(k.where(~held_out), "id", "content", "category")
    return predict(k).select("id", held_out.alias("held_out"), "category", "predicted")
