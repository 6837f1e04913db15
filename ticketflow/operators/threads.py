"""Threads and conversations.

A thread is the set of log rows sharing a non-empty ``thread_ts``; rows
without one are singletons keyed ``no-thread-<id>``, which also keeps the
empty-thread rows from forming one giant skewed group.

Per-thread facts are computed with ``min_by``/``max_by`` aggregates, which
combine map-side, so a thread holding a third of all rows costs one partial
row per map task rather than one task holding the whole thread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketflow.functions.skew import sequence_within
from ticketflow.functions.timeutil import epoch_millis

CONVERSATION_TYPES = ("INQUIRY", "AI_RESPONSE")
HISTORY_DEPTH = 20  # fixed value: reference agent context depth


def thread_key(df: DataFrame, thread_col: str = "thread_ts", id_col: str = "id") -> DataFrame:
    t = F.col(thread_col)
    return df.withColumn("thread_key", F.when(t.isNotNull() & (t != ""), t)
                         .otherwise(F.concat(F.lit("no-thread-"), F.col(id_col).cast("string"))))


def _ord():
    return F.struct(F.col("created_at"), F.col("id"))


def thread_summary(logs: DataFrame) -> DataFrame:
    """Per thread: first message (first INQUIRY's, else the first row's,
    else '-'), start time, has evaluation, first evaluation, status of the
    last row, row count. Ties on created_at are broken by id.
    """
    lt = F.col("log_type")
    k = thread_key(logs)
    inq_msg = F.min_by(F.when(lt == "INQUIRY", F.col("message")),
                       F.when(lt == "INQUIRY", _ord()))
    first_msg = F.min_by(F.col("message"), _ord())
    first_eval = F.min_by(F.when(lt == "EVALUATION", F.col("evaluation")),
                          F.when(lt == "EVALUATION", _ord()))
    agg = k.groupBy("thread_key").agg(
        inq_msg.alias("_inq"), first_msg.alias("_first"),
        F.min("created_at").alias("created_at"),
        F.count_if(lt == "EVALUATION").alias("_evals"),
        first_eval.alias("_eval"),
        F.max_by(F.col("status"), _ord()).alias("status"),
        F.count(F.lit(1)).alias("log_count"))

    def nz(c):
        return F.when(c.isNotNull() & (c != ""), c)

    return agg.select(
        "thread_key",
        F.coalesce(nz(F.col("_inq")), nz(F.col("_first")), F.lit("-")).alias("first_message"),
        "created_at",
        (F.col("_evals") > 0).alias("has_evaluation"),
        nz(F.col("_eval")).alias("evaluation_result"),
        "status", "log_count")


def thread_stats(summary: DataFrame) -> DataFrame:
    """Threads; resolved (helpful/resolved); escalated; pending (no evaluation)."""
    ev = F.col("evaluation_result")
    return summary.agg(
        F.count(F.lit(1)).alias("threads"),
        F.count_if(ev.isin("helpful", "resolved")).alias("resolved"),
        F.count_if(ev == "escalate").alias("escalated"),
        F.count_if(~F.col("has_evaluation")).alias("pending"))


def conversation_rows(logs: DataFrame) -> DataFrame:
    """rows of real threads (thread not null/'') of type INQUIRY or AI_RESPONSE."""
    t = F.col("thread_ts")
    return logs.where(t.isNotNull() & (t != "") & F.col("log_type").isin(*CONVERSATION_TYPES))


def conversation_window(logs: DataFrame, depth: int = HISTORY_DEPTH, newest: bool = False) -> DataFrame:
    """The first ``depth`` conversation rows per thread, ascending.

    ``newest=True`` keeps the latest ``depth`` instead (the reference keeps the
    oldest, which drops recent turns). ``row_number() <= k`` is planned with a
    partial WindowGroupLimit before the shuffle, so a hot thread sends at most
    ``depth`` rows per map task.
    """
    rows = conversation_rows(logs)
    o = [F.col("created_at").desc(), F.col("id").desc()] if newest else [F.col("created_at"), F.col("id")]
    w = Window.partitionBy("thread_ts").orderBy(*o)
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= depth)


def turn_numbers(logs: DataFrame, strict_reference: bool = False,
                 carry: tuple[str, ...] = ("id", "thread_ts", "created_at", "log_type")) -> DataFrame:
    """Turn index of each conversation row in its thread and is_multi_turn.

    Only the ``carry`` columns (key, order and id among them) are staged and
    shuffled; join the rest on the id. The position is computed with the
    skew-safe sequence (range partitioned), the thread size with a
    map-side-combined count joined back (grouped by a wrapped key, so that
    adaptive execution can split a hot thread).
    ``strict_reference=True`` reproduces the reference double count (the
    current message is already stored and pushed again: turn + 1, always
    multi-turn).
    """
    rows = conversation_rows(logs).select(*carry)
    seq = sequence_within(rows, ["thread_ts"], ["created_at", "id"], "turn_number")
    sizes = (rows.groupBy(F.struct("thread_ts").alias("_k")).agg(F.count(F.lit(1)).alias("_thread_rows"))
             .select(F.col("_k.thread_ts").alias("thread_ts"), "_thread_rows"))
    out = seq.join(sizes, "thread_ts")
    if strict_reference:
        return (out.withColumn("turn_number", (F.col("turn_number") + 1).cast("int"))
                .withColumn("is_multi_turn", F.lit(True)).drop("_thread_rows"))
    return (out.withColumn("turn_number", F.col("turn_number").cast("int"))
            .withColumn("is_multi_turn", F.col("_thread_rows") > 1).drop("_thread_rows"))


def first_last_in_thread(logs: DataFrame) -> DataFrame:
    """Each row with its thread's first inquiry message and latest status.

    Computed as a grouped aggregate (map-side combined) joined back on the
    thread key. It is grouped by a wrapped key, so the join has exchanges of its
    own and adaptive execution can split a thread with very many rows.
    """
    k = thread_key(logs)
    lt = F.col("log_type")
    facts = k.groupBy(F.struct("thread_key").alias("_k")).agg(
        F.min_by(F.when(lt == "INQUIRY", F.col("message")), F.when(lt == "INQUIRY", _ord()))
         .alias("first_inquiry_message"),
        F.max_by(F.col("status"), _ord()).alias("latest_status")) \
        .select(F.col("_k.thread_key").alias("thread_key"), "first_inquiry_message", "latest_status")
    return k.join(facts, "thread_key")


def build_messages(window_rows: DataFrame) -> DataFrame:
    """Per thread, the agent message array as JSON.

    INQUIRY -> user with its message; AI_RESPONSE with text -> assistant.
    Input is W2 output, so each collected list holds at most ``depth`` rows.
    """
    lt = F.col("log_type")
    msg = (F.when(lt == "INQUIRY", F.struct(F.lit("user").alias("role"), F.col("message").alias("text")))
           .when((lt == "AI_RESPONSE") & F.col("ai_response_text").isNotNull()
                 & (F.col("ai_response_text") != ""),
                 F.struct(F.lit("assistant").alias("role"), F.col("ai_response_text").alias("text"))))
    items = window_rows.select("thread_ts", "position", msg.alias("m")).where(F.col("m").isNotNull())
    grouped = items.groupBy("thread_ts").agg(
        F.sort_array(F.collect_list(F.struct("position", "m"))).alias("_ms"))
    content = F.transform("_ms", lambda x: F.struct(
        x["m"]["role"].alias("role"),
        F.array(F.struct(F.lit("text").alias("type"), x["m"]["text"].alias("text"))).alias("content")))
    return grouped.select("thread_ts", F.size("_ms").alias("message_count"),
                          F.to_json(content).alias("messages_json"))


def ticket_conversation(tickets: DataFrame, logs: DataFrame) -> DataFrame:
    """Each ticket with the log rows of its (non-empty) thread.

    Tickets without a thread or without logs keep one row with NULL log
    columns. The equi-join shuffles both sides on thread_ts (or broadcasts
    a side under the threshold); AQE splits a skewed thread.
    """
    t = tickets.select("ticket_id", F.col("thread_ts").alias("_t_thread"))
    lg = logs.where(F.col("thread_ts").isNotNull() & (F.col("thread_ts") != "")).select(
        F.col("thread_ts").alias("_l_thread"), F.col("id").alias("log_id"), "log_type",
        "message", "ai_response_text", F.col("created_at").alias("log_created_at"))
    return t.join(lg, F.col("_t_thread") == F.col("_l_thread"), "left").select(
        "ticket_id", F.col("_t_thread").alias("thread_ts"), "log_id", "log_type", "message",
        "ai_response_text", "log_created_at")


def children_of(parents: DataFrame, children: DataFrame, key: str, order: list,
                descending: bool = False, name: str = "ordinal") -> DataFrame:
    """Child rows (comments, history) of each parent with their ordinal.

    Semi-joins children to existing parents, then numbers them per parent
    (ascending for comments, newest first for history) with the skew-safe
    sequence; nothing is collected per parent. A semi-join needs no distinct
    parents; without an aggregate both sides have exchanges of their own, so
    adaptive execution can split a hot parent.
    """
    kids = children.join(parents.select(key), key, "left_semi")
    o = [F.col(c).desc() if descending else F.col(c) for c in order]
    return sequence_within(kids, [key], o, name)


def reply_chain(logs: DataFrame) -> DataFrame:
    """INQUIRY <- AI_RESPONSE.inquiry_id, AI_RESPONSE <- EVALUATION.inquiry_id.

    One row per (inquiry, response, evaluation or none): response latency in
    ms and the outcome of the evaluation (pending when none).
    """
    lt = F.col("log_type")
    inq = logs.where(lt == "INQUIRY").select(
        F.col("id").alias("inquiry_id"), F.col("created_at").alias("_inq_at"), "thread_ts", "category")
    resp = logs.where(lt == "AI_RESPONSE").select(
        F.col("id").alias("response_id"), F.col("inquiry_id").alias("_r_inq"),
        F.col("created_at").alias("_resp_at"))
    ev = logs.where(lt == "EVALUATION").select(
        F.col("id").alias("evaluation_id"), F.col("inquiry_id").alias("_e_resp"), "evaluation")
    chain = (inq.join(resp, F.col("inquiry_id") == F.col("_r_inq"))
             .join(ev, F.col("response_id") == F.col("_e_resp"), "left"))
    e = F.col("evaluation")
    outcome = (F.when(F.col("evaluation_id").isNull(), "pending")
               .when(e.isin("resolved", "helpful"), "resolved")
               .when(e == "escalate", "escalated")
               .when(e == "direct_ticket", "human").otherwise(e))
    return chain.select(
        "inquiry_id", "response_id", "evaluation_id", "thread_ts", "category",
        (epoch_millis("_resp_at") - epoch_millis("_inq_at")).alias("response_ms"),
        "evaluation", outcome.alias("outcome"))
