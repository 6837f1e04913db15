"""Ticket lifecycle: patches, change logs, feedback folds, ticket creation,
dedupe and integrity checks (P1-P4, W1, W5, W6, J4-J6, T4 batch, E3, E14,
create_ticket / update_ticket_status routines).

Row-level updates are expressed as folds over change rows plus a join to
the current state, never as in-place mutation. Every fold is an aggregate
(``max_by``/``min_by``/``max`` with a total order), so it combines map-side,
gives the same answer on replay, and does not gather a hot ticket's
changes into one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketflow.functions import text
from ticketflow.functions.skew import sequence_within
from ticketflow.functions.timeutil import col_of, lit_ts

DONE = ("RESOLVED", "CLOSED")

# Queue prefixes of ticket ids, history labels, routine texts.
QUEUE_PREFIX = {"it": "IT-", "hr": "HR-", "finance": "FIN-", "general": "GEN-"}
CATEGORY_QUEUE = {"it": "it", "it_asset": "it", "hr": "hr", "finance": "finance", "other": "general"}
FIELD_LABELS = {"status": "ステータス", "assigned_to": "担当者", "resolution_notes": "対応メモ"}
HISTORY_ACTION = "変更"
DEFAULT_AUTHOR = "システム"
ACTION_CREATED_TEXT = "チケット自動作成: "
ACTION_UPDATED_TEXT = "ステータス変更: "
PLAIN_CHANNELS = ("slack", "web", "email")


# ---------------------------------------------------------------- P3, P4, E3, E13

def queue_of(ticket_id) -> Column:
    """Id prefix -> queue (FIN- finance, HR- hr, else it)."""
    t = col_of(ticket_id)
    return F.when(t.startswith("FIN-"), "finance").when(t.startswith("HR-"), "hr").otherwise("it")


def table_of_category(category) -> Column:
    """Category -> target table (hr, finance, else helpdesk); null -> 'it'."""
    c = F.lower(F.coalesce(F.nullif(col_of(category), F.lit("")), F.lit("it")))
    return (F.when(c == "hr", "hr_tickets").when(c == "finance", "finance_tickets")
            .otherwise("helpdesk_tickets"))


def ticket_id_ts(prefix, ts) -> Column:
    """Prefix + yyyyMMdd-HHmmss of the creation time (collides within a second)."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(p, F.date_format(col_of(ts), "yyyyMMdd-HHmmss"))


def resolve_channel(source_channel, default_channel: str = "") -> Column:
    """The ticket's channel unless it is slack/web/email/empty, else the default."""
    ch = col_of(source_channel)
    return F.when(ch.isNotNull() & (ch != "") & ~ch.isin(*PLAIN_CHANNELS), ch) \
            .otherwise(F.lit(default_channel))


# ---------------------------------------------------------------- P1, P2

def patch_columns(current: DataFrame, patches: DataFrame, key: str, columns: list[str], now,
                  order_col: str | None = None, status_col: str = "status") -> DataFrame:
    """P1 + P2: apply patches with COALESCE(new, old) per column.

    Several patches of one key in a batch fold in ``order_col`` order: per
    column the last non-null value wins (NULL keeps the old value, ''
    overwrites). ``updated_at`` becomes ``now`` for patched rows, and
    ``resolved_at`` becomes ``now`` when the patched status is RESOLVED or
    CLOSED (P2).
    """
    o = F.col(order_col) if order_col else F.lit(0)
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), o)).alias(f"_new_{c}") for c in columns]
    folded = patches.groupBy(key).agg(*last, F.lit(True).alias("_patched"))
    j = current.join(folded, key, "left")
    out = j
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(f"_new_{c}"), F.col(c)))
    patched = F.coalesce(F.col("_patched"), F.lit(False))
    if "updated_at" in current.columns:
        out = out.withColumn("updated_at", F.when(patched, lit_ts(now)).otherwise(F.col("updated_at")))
    if status_col in columns and "resolved_at" in current.columns:
        out = out.withColumn("resolved_at", F.when(F.col(f"_new_{status_col}").isin(*DONE), lit_ts(now))
                             .otherwise(F.col("resolved_at")))
    return out.drop("_patched", *[f"_new_{c}" for c in columns])


# ---------------------------------------------------------------- W5, E14

def previous_version(versions: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Skew-safe ``lag``: number versions per key, join each to its predecessor.

    The join is on (key, position), which is unique, so a ticket with
    millions of versions spreads over all tasks.
    """
    seq = sequence_within(versions, [key], order, "_pos")
    prev = seq.select(F.col(key).alias("_pk"), (F.col("_pos") + 1).alias("_ppos"),
                      *[F.col(c).alias(f"_old_{c}") for c in columns])
    return seq.join(prev, (F.col(key) == F.col("_pk")) & (F.col("_pos") == F.col("_ppos")), "left") \
              .drop("_pk", "_ppos")


def change_log(versions: DataFrame, key: str = "ticket_id", order: list[str] = ("changed_at", "version_id"),
               fields: list[str] = ("status", "assigned_to", "resolution_notes"),
               at_col: str = "changed_at", author_col: str = "author", null_text: bool = False) -> DataFrame:
    """One history row per field whose value differs from the previous version.

    Comparison is null-safe (``!==``). ``null_text=True`` stores null and ''
    as the text 'null' as the reference does; the default keeps NULL.
    """
    order, fields = list(order), list(fields)
    pv = previous_version(versions, key, order, fields)
    has_prev = F.col("_pos") > 1
    items = [F.struct(F.lit(f).alias("field"), F.lit(FIELD_LABELS.get(f, f)).alias("field_label"),
                      F.col(f"_old_{f}").cast("string").alias("old_value"),
                      F.col(f).cast("string").alias("new_value"),
                      (has_prev & ~F.col(f"_old_{f}").eqNullSafe(F.col(f))).alias("changed"))
             for f in fields]
    out = pv.select(F.col(key), F.col(at_col).alias("created_at"),
                    F.coalesce(F.col(author_col), F.lit(DEFAULT_AUTHOR)).alias("author"),
                    *[F.col(c) for c in order if c not in (key, at_col)],
                    F.inline(F.array(*items))).where("changed").drop("changed")
    out = out.withColumn("action", F.lit(HISTORY_ACTION))
    if null_text:
        for c in ("old_value", "new_value"):
            out = out.withColumn(c, F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("null")))
    return out


def notification_events(history: DataFrame, comments: DataFrame | None = None,
                        tickets: DataFrame | None = None, key: str = "ticket_id") -> DataFrame:
    """Who must be told, as an outbox of (ticket, kind, author, old, new).

    status / assignee / note changes come from the change log; a comment is
    announced when its author is the ticket's assignee.
    """
    kind = (F.when(F.col("field") == "status", "status_change")
            .when(F.col("field") == "assigned_to", "assignee_change")
            .when(F.col("field") == "resolution_notes", "note"))
    out = history.select(F.col(key), kind.alias("kind"), "author", "old_value", "new_value",
                         F.col("created_at")).where(F.col("kind").isNotNull())
    if comments is not None and tickets is not None:
        c = comments.join(tickets.select(key, "assigned_to"), key).where(
            F.col("assigned_to").isNotNull() & (F.col("assigned_to") == F.col("author")))
        out = out.unionByName(c.select(F.col(key), F.lit("comment").alias("kind"), "author",
                                       F.lit(None).cast("string").alias("old_value"),
                                       F.col("content").alias("new_value"), "created_at"))
    return out


# ---------------------------------------------------------------- W1 / J5, S7 key choice

def dedupe_keep_first(df: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """Keep the row with the minimum id per key (NULL keys form one group).

    Implemented as a partial-aggregated ``min(id)`` per key and a join on
    (key, id): a key holding a third of the rows is pre-reduced map-side, and
    the join hashes on the pair, so no task receives the whole hot key.
    """
    firsts = df.groupBy(key).agg(F.min(id_col).alias("_first_id"))
    f = firsts.select(F.col(key).alias("_dk"), "_first_id")
    return df.join(f, F.col(key).eqNullSafe(F.col("_dk")) & (F.col(id_col) == F.col("_first_id")),
                   "left_semi")


def duplicates_to_delete(df: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """Ids that ``DELETE ... WHERE id NOT IN (SELECT MIN(id) ... GROUP BY key)`` removes."""
    firsts = df.groupBy(key).agg(F.min(id_col).alias("_first_id"))
    f = firsts.select(F.col(key).alias("_dk"), "_first_id")
    return df.join(f, F.col(key).eqNullSafe(F.col("_dk")) & (F.col(id_col) == F.col("_first_id")),
                   "left_anti").select(id_col, key)


# ---------------------------------------------------------------- W6

def ticket_ordinal(tickets: DataFrame, order: list[str] = ("created_at", "ticket_id"),
                   prefix: str = "TKT-", date_col: str = "created_at", start: int = 0) -> DataFrame:
    """W6: 'TKT-YYYYMMDD-00001' from one global sequence over a total order.

    A global ``row_number()`` without partitioning runs in one task; the
    skew-safe sequence range-partitions instead. The number is padded to 5
    digits and never cut: cut ids would collide beyond 99999 rows. The first
    number is ``start`` + 1.
    """
    seq = sequence_within(tickets, [], list(order), "_ordinal").withColumn("_ordinal", F.col("_ordinal") + F.lit(start))
    return seq.withColumn("ordinal_id", F.concat(
        F.lit(prefix), F.date_format(date_col, "yyyyMMdd"), F.lit("-"),
        F.lpad(F.col("_ordinal").cast("string"), F.greatest(F.lit(5), F.length(F.col("_ordinal").cast("string"))), F.lit("0")))) \
        .withColumnRenamed("_ordinal", "ordinal")


# ---------------------------------------------------------------- J4, create / update routines

def open_tickets(candidates: DataFrame, existing: DataFrame | None, queue_col: str = "queue",
                 thread_col: str = "thread_ts", order: list[str] = ("created_at", "log_id")) -> DataFrame:
    """J4 + E3: tickets to create for candidate messages.

    A candidate needs a ticket when no existing ticket of its queue (id
    prefix) has the same non-empty thread; within the batch the first
    candidate per (queue, thread) wins. Empty or NULL threads never match, so
    each such candidate creates its own ticket. Ids are prefix +
    yyyyMMdd-HHmmss; colliding ids within one second get '-2', '-3', ...
    """
    prefix_map = F.create_map(*[x for k, v in QUEUE_PREFIX.items() for x in (F.lit(k), F.lit(v))])
    c = candidates.withColumn("_prefix", F.coalesce(F.try_element_at(prefix_map, F.col(queue_col)), F.lit("GEN-")))
    t = F.col(thread_col)
    real = t.isNotNull() & (t != "")
    threaded, loose = c.where(real), c.where(~real)
    o = F.struct(*[F.col(x) for x in order])
    rest = [x for x in threaded.columns if x not in ("_prefix", thread_col)]
    threaded = (threaded.groupBy("_prefix", thread_col)
                .agg(F.min_by(F.struct(*rest), o).alias("_r"))
                .select("_r.*", "_prefix", thread_col))
    if existing is not None:
        have = existing.where(F.col(thread_col).isNotNull() & (F.col(thread_col) != "")).select(
            F.col(thread_col), F.regexp_extract("ticket_id", r"^([A-Z]+-)", 1).alias("_prefix")).distinct()
        threaded = threaded.join(have, ["_prefix", thread_col], "left_anti")
    new = threaded.unionByName(loose)
    new = new.withColumn("_base_id", ticket_id_ts(F.col("_prefix"), F.col("created_at")))
    new = sequence_within(new, ["_base_id"], list(order), "_dup")
    if existing is not None:
        # ids already taken in the same second (earlier batches) shift the suffix numbering
        taken = (existing.select(F.regexp_extract("ticket_id", r"^([A-Z]+-\d{8}-\d{6})", 1).alias("_base_id"))
                 .where(F.col("_base_id") != "").groupBy("_base_id").agg(F.count(F.lit(1)).alias("_taken")))
        new = new.join(taken, "_base_id", "left").withColumn(
            "_dup", F.col("_dup") + F.coalesce(F.col("_taken"), F.lit(0))).drop("_taken")
    return new.withColumn("ticket_id", F.when(F.col("_dup") == 1, F.col("_base_id"))
                          .otherwise(F.concat(F.col("_base_id"), F.lit("-"), F.col("_dup").cast("string")))) \
              .drop("_prefix", "_base_id", "_dup")


ACTION_SCHEMA = "ticket_id string, action_type string, action_by string, action_details string, created_at timestamp_ntz"


def created_actions(tickets: DataFrame) -> DataFrame:
    """One CREATED action per ticket, which names the source channel."""
    return tickets.select("ticket_id", F.lit("CREATED").alias("action_type"), F.lit("SYSTEM").alias("action_by"),
                          F.concat(F.lit(ACTION_CREATED_TEXT), F.coalesce("source_channel", F.lit(""))).alias("action_details"), "created_at")


def create_tickets(requests: DataFrame, ordinal_prefix: str = "TKT-", start: int = 0) -> tuple[DataFrame, DataFrame]:
    """create_ticket routine, batch form: (tickets, actions).

    Tickets get the W6 ordinal id, numbered from ``start`` + 1; batches that share
    a table go through ``streaming.upkeep.create_tickets_batch``, which goes on
    after the last number published.
    """
    t = ticket_ordinal(requests, ["created_at", "request_id"], ordinal_prefix, start=start)
    t = t.withColumn("ticket_id", F.col("ordinal_id")).drop("ordinal_id", "ordinal")
    t = t.withColumn("status", F.coalesce(F.col("status"), F.lit("OPEN"))) if "status" in t.columns \
        else t.withColumn("status", F.lit("OPEN"))
    return t, created_actions(t)


def update_ticket_status(tickets: DataFrame, updates: DataFrame, now) -> tuple[DataFrame, DataFrame, DataFrame]:
    """update_ticket_status routine, batch form: (tickets', actions, found).

    ``updates``: ticket_id, status, assigned_to, resolution_notes, action_by,
    seq (order within the batch). Status is set (not coalesced); the others
    are coalesced. ``found`` says per update whether its ticket exists (semi
    join); UPDATED actions are written only for found ones.
    """
    u = updates.withColumn("action_by", F.coalesce("action_by", F.lit("SYSTEM")))
    found = u.join(tickets.select("ticket_id"), "ticket_id", "left_semi")
    folded = found.groupBy("ticket_id").agg(
        F.max_by("status", "seq").alias("_st"),
        F.max_by(F.col("assigned_to"), F.when(F.col("assigned_to").isNotNull(), F.col("seq"))).alias("_as"),
        F.max_by(F.col("resolution_notes"), F.when(F.col("resolution_notes").isNotNull(), F.col("seq")))
         .alias("_rn"))
    t = tickets.join(folded, "ticket_id", "left")
    t = (t.withColumn("status", F.coalesce(F.col("_st"), F.col("status")))
          .withColumn("assigned_to", F.coalesce(F.col("_as"), F.col("assigned_to")))
          .withColumn("resolution_notes", F.coalesce(F.col("_rn"), F.col("resolution_notes")))
          .withColumn("resolved_at", F.when(F.col("_st").isin(*DONE), lit_ts(now)).otherwise(F.col("resolved_at")))
          .drop("_st", "_as", "_rn"))
    actions = found.select("ticket_id", F.lit("UPDATED").alias("action_type"), "action_by",
                           F.concat(F.lit(ACTION_UPDATED_TEXT), F.col("status")).alias("action_details"),
                           lit_ts(now).alias("created_at"), "seq")
    flag = u.join(tickets.select("ticket_id", F.lit(True).alias("found")), "ticket_id", "left") \
            .withColumn("found", F.coalesce("found", F.lit(False)))
    return t, actions, flag


# ---------------------------------------------------------------- T4 batch fold

def feedback_branch(evaluation) -> Column:
    """Branch of a feedback value: direct_ticket, escalate, anything else resolves."""
    e = col_of(evaluation)
    return F.when(e == "direct_ticket", "direct").when(e == "escalate", "escalate").otherwise("resolved")


def apply_feedback_logs(logs: DataFrame, feedback: DataFrame) -> DataFrame:
    """T4 on the log table, as a deterministic fold of feedback events.

    Feedback rows: log_id, thread_ts, evaluation, at, seq. In event order:
    direct -> the log HUMAN_REQUESTED; escalate -> the log ESCALATED;
    otherwise the log RESOLVED with resolved_at, then every row of the
    (non-empty) thread not RESOLVED/ESCALATED becomes RESOLVED.
    """
    fb = feedback.withColumn("_branch", feedback_branch("evaluation"))
    o = F.struct("at", "seq")
    new_status = (F.when(F.col("_branch") == "direct", "HUMAN_REQUESTED")
                  .when(F.col("_branch") == "escalate", "ESCALATED").otherwise("RESOLVED"))
    point = fb.groupBy(F.col("log_id").alias("_fid")).agg(
        F.max_by(new_status, o).alias("_p_status"), F.max(o).alias("_p_at"),
        F.max(F.when(F.col("_branch") == "resolved", F.col("at"))).alias("_p_resolved_at"))
    thr = fb.where((F.col("_branch") == "resolved") & F.col("thread_ts").isNotNull() & (F.col("thread_ts") != ""))
    # grouped by a wrapped key: the join gets exchanges of its own, and a hot thread can be split
    thread_res = (thr.groupBy(F.struct("thread_ts").alias("_k")).agg(F.max(o).alias("_t_at"))
                  .select(F.col("_k.thread_ts").alias("_tts"), "_t_at"))
    j = (logs.join(point, F.col("id") == F.col("_fid"), "left")
         .join(thread_res, F.col("thread_ts") == F.col("_tts"), "left"))
    after_point = F.coalesce(F.col("_p_status"), F.col("status"))
    thread_later = F.col("_t_at").isNotNull() & (F.col("_p_at").isNull() | (F.col("_t_at") > F.col("_p_at")))
    final = F.when(thread_later & ~after_point.isin("RESOLVED", "ESCALATED"), F.lit("RESOLVED")) \
             .otherwise(after_point)
    return (j.withColumn("status", final)
            .withColumn("resolved_at", F.coalesce(F.col("_p_resolved_at"), F.col("resolved_at")))
            .drop("_fid", "_p_status", "_p_at", "_p_resolved_at", "_tts", "_t_at"))


def apply_feedback_tickets(tickets: DataFrame, feedback: DataFrame) -> DataFrame:
    """T4 on tickets: the last event's status wins; direct sets urgency LOW;
    resolved_at is the last resolving event's time."""
    fb = feedback.withColumn("_branch", feedback_branch("evaluation"))
    o = F.struct("at", "seq")
    new_status = (F.when(F.col("_branch") == "direct", "HUMAN_REQUESTED")
                  .when(F.col("_branch") == "escalate", "ESCALATED").otherwise("RESOLVED"))
    fold = fb.where(F.col("ticket_id").isNotNull() & (F.col("ticket_id") != "")).groupBy(
        F.col("ticket_id").alias("_ftid")).agg(
        F.max_by(new_status, o).alias("_f_status"),
        F.max(F.col("_branch") == "direct").alias("_f_direct"),
        F.max(F.when(F.col("_branch") == "resolved", F.col("at"))).alias("_f_resolved_at"))
    j = tickets.join(fold, F.col("ticket_id") == F.col("_ftid"), "left")
    return (j.withColumn("status", F.coalesce("_f_status", "status"))
            .withColumn("urgency", F.when(F.coalesce("_f_direct", F.lit(False)), F.lit("LOW"))
                        .otherwise(F.col("urgency")))
            .withColumn("resolved_at", F.coalesce("_f_resolved_at", "resolved_at"))
            .drop("_ftid", "_f_status", "_f_direct", "_f_resolved_at"))


# ---------------------------------------------------------------- F10

def gate_by_article(responses: DataFrame, articles: DataFrame) -> DataFrame:
    """``responses`` (can_resolve, confidence, matched_kb_id, ...) with a
    ``decision``, by the matched article's own threshold and requires_escalation.

    A response that matches no article, or one without a threshold, is held to
    the common one. Articles are gathered under a wrapped key, so that an article
    that most responses match can be split.
    """
    own = (articles.groupBy(F.struct("kb_id").alias("_k")).agg(F.max(F.struct("confidence_threshold", "requires_escalation")).alias("_a"))
           .select(F.col("_k.kb_id").alias("matched_kb_id"), "_a"))
    gate = text.confidence_gate("can_resolve", "confidence", F.col("_a.confidence_threshold"), F.col("_a.requires_escalation"))
    return responses.join(own, "matched_kb_id", "left").withColumn("decision", gate).drop("_a")


# ---------------------------------------------------------------- J6

def _violations(df: DataFrame, table: str, rule: str, key: str) -> DataFrame:
    return df.select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
                     F.col(key).cast("string").alias("record_key"))


def orphan_check(tickets: DataFrame, logs: DataFrame, assets: DataFrame | None = None,
                 employees: DataFrame | None = None, escalations: DataFrame | None = None) -> DataFrame:
    """Foreign-key and CHECK rules as violation rows (table, rule, key).

    NULL foreign keys pass. FK rules are left-anti joins against the
    distinct parent keys; CHECK rules are ``isin``/``between`` filters.
    """
    from ticketflow import schemas
    parts = [
        _violations(tickets.where(F.col("log_id").isNotNull())
                    .join(logs.select(F.col("id").alias("log_id")), "log_id", "left_anti"),
                    "helpdesk_tickets", "fk_log_id", "ticket_id"),
        _violations(tickets.where(F.col("status").isNull() | ~F.col("status").isin(*schemas.STATUSES)),
                    "helpdesk_tickets", "check_status", "ticket_id"),
        _violations(tickets.where(F.col("urgency").isNotNull() & ~F.col("urgency").isin(*schemas.URGENCIES)),
                    "helpdesk_tickets", "check_urgency", "ticket_id"),
        _violations(logs.where(~F.col("log_type").isin(*schemas.LOG_TYPES)),
                    "helpdesk_logs", "check_log_type", "id"),
        _violations(logs.where(F.col("inquiry_id").isNotNull())
                    .join(logs.select(F.col("id").alias("inquiry_id")), "inquiry_id", "left_anti"),
                    "helpdesk_logs", "fk_inquiry_id", "id"),
    ]
    if assets is not None and employees is not None:
        parts.append(_violations(
            assets.where(F.col("assignee").isNotNull())
            .join(employees.select(F.col("employee_name").alias("assignee")), "assignee", "left_anti"),
            "assets", "fk_assignee", "asset_id"))
    if escalations is not None:
        parts.append(_violations(
            escalations.where(F.col("feedback_rating").isNotNull() & ~F.col("feedback_rating").between(1, 5)),
            "escalation_log", "check_rating", "escalation_id"))
        parts.append(_violations(
            escalations.where(F.col("ticket_id").isNotNull())
            .join(tickets.select("ticket_id"), "ticket_id", "left_anti"),
            "escalation_log", "fk_ticket_id", "escalation_id"))
    return reduce(lambda a, b: a.unionByName(b), parts)
