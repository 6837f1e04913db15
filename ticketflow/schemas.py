"""Reference-shaped table schemas (canonical: the newest DDL generation).

Types follow FIXTURES.md section 1. Timestamps are ``TimestampNTZType`` in
batch; streaming code casts to ``TimestampType`` before watermarking.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
TS = T.TimestampNTZType()


def _f(name, typ, nullable=True):
    return T.StructField(name, typ, nullable)


CONFIDENCE = T.ArrayType(T.StructType([_f("id", S), _f("score", D), _f("text", S)]))

HELPDESK_LOGS = T.StructType([
    _f("id", L, False), _f("log_type", S, False), _f("inquiry_id", L), _f("user_id", S),
    _f("channel_id", S), _f("thread_ts", S), _f("message", S), _f("category", S),
    _f("priority", S), _f("summary", S), _f("ai_response", S), _f("ai_response_text", S),
    _f("resolution_steps", T.ArrayType(S)), _f("needs_escalation", B), _f("escalation_team", S),
    _f("matched_kb_ids", S), _f("confidence_scores", CONFIDENCE), _f("tokens_input", I),
    _f("tokens_output", I), _f("model_name", S), _f("turn_number", I), _f("is_multi_turn", B),
    _f("evaluation", S), _f("evaluation_comment", S), _f("status", S), _f("created_at", TS),
    _f("resolved_at", TS),
])

HELPDESK_TICKETS = T.StructType([
    _f("ticket_id", S, False), _f("reporter_name", S), _f("reporter_employee_id", S),
    _f("location", S), _f("issue_type", S), _f("urgency", S), _f("summary", S),
    _f("details", T.ArrayType(S)), _f("matched_asset_id", S), _f("log_id", L), _f("thread_ts", S),
    _f("source_channel", S), _f("status", S), _f("assigned_to", S), _f("resolution_notes", S),
    _f("created_at", TS), _f("updated_at", TS), _f("resolved_at", TS),
])

TICKET_HISTORY = T.StructType([
    _f("id", L, False), _f("ticket_id", S, False), _f("action", S), _f("field", S),
    _f("old_value", S), _f("new_value", S), _f("author", S), _f("created_at", TS),
])

TICKET_COMMENTS = T.StructType([
    _f("id", L, False), _f("ticket_id", S, False), _f("author", S), _f("content", S),
    _f("created_at", TS),
])

KNOWLEDGE_ARTICLES = T.StructType([
    _f("id", L, False), _f("title", S), _f("content", S), _f("category", S), _f("tags", S),
    _f("views", I), _f("author", S), _f("created_at", TS), _f("updated_at", TS),
])

ASSETS = T.StructType([
    _f("id", L, False), _f("asset_id", S), _f("asset_type", S), _f("name", S), _f("assignee", S),
    _f("location", S), _f("status", S), _f("purchase_date", T.DateType()), _f("notes", S),
    _f("created_at", TS), _f("updated_at", TS),
])

SERVICE_CATALOG = T.StructType([
    _f("id", L, False), _f("title", S), _f("description", S), _f("category", S), _f("icon", S),
    _f("sla_hours", I), _f("active", B), _f("created_at", TS),
])

SYSTEM_SETTINGS = T.StructType([
    _f("id", L, False), _f("setting_key", S), _f("setting_value", S), _f("setting_type", S),
    _f("description", S), _f("updated_at", TS),
])

ESCALATION_LOG = T.StructType([
    _f("escalation_id", S, False), _f("ticket_id", S), _f("log_id", L), _f("original_message", S),
    _f("ai_response", S), _f("ai_confidence", D), _f("escalation_reason", S),
    _f("escalation_team", S), _f("assigned_to", S), _f("resolution_notes", S),
    _f("feedback_rating", I), _f("escalated_at", TS), _f("resolved_at", TS),
])

# Inbound chat message (JSON) and button feedback (JSON).
INBOUND_MESSAGE = T.StructType([
    _f("event_id", S), _f("type", S), _f("subtype", S), _f("bot_id", S), _f("channel_id", S),
    _f("channel_type", S), _f("thread_ts", S), _f("ts", S), _f("user_id", S), _f("user_name", S),
    _f("message", S), _f("event_ts", S), _f("category", S), _f("category_label", S),
    _f("source", S), _f("retry_num", I), _f("_corrupt_record", S),
])

FEEDBACK_EVENT = T.StructType([
    _f("value", S), _f("log_id", S), _f("ticket_id", S), _f("category", S), _f("user_id", S),
    _f("channel_id", S), _f("thread_ts", S), _f("evaluation", S), _f("comment", S),
])

# Enumerations of the reference data model.
STATUSES = ["OPEN", "IN_PROGRESS", "RESOLVED", "CLOSED", "ESCALATED", "HUMAN_REQUESTED"]
URGENCIES = ["HIGH", "MEDIUM", "LOW"]
LOG_TYPES = ["INQUIRY", "AI_RESPONSE", "EVALUATION", "INFO_RECEIVED"]
EVALUATIONS = ["resolved", "helpful", "not_helpful", "escalate", "direct_ticket"]
QUEUE_CATEGORIES = ["it_asset", "hr", "finance", "other"]
ACTIVE_STATUSES = ["OPEN", "IN_PROGRESS", "HUMAN_REQUESTED"]
DONE_STATUSES = ["RESOLVED", "CLOSED"]
