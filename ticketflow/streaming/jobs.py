"""Structured Streaming jobs.

Every job reads a file stream (or any streaming DataFrame), applies the same
column functions and operators as the batch code, and writes to a
replay-safe sink with its checkpoint in the shared checkpoint folder.
``trigger(availableNow=True)`` runs a job as a bounded catch-up; any other
trigger runs it continuously.

Event time: the reference stores zone-less timestamps; watermarks need
``TimestampType``, so event-time columns are cast (session time zone UTC).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketflow import schemas
from ticketflow.functions import sla, text
from ticketflow.operators import kpi, lifecycle
from ticketflow.functions.skew import running_sum_within, sequence_within
from ticketflow.session import checkpoint_dir, cut_lineage
from ticketflow.streaming import sinks
from ticketflow.streaming.state_table import StateTable


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local temp dir)."""
    return checkpoint_dir(spark).rstrip("/") + f"/{name}-{uuid.uuid4().hex[:12]}"


def checkpoint_of(table: str, checkpoint: str | None) -> str:
    """The stream's checkpoint: the given one, or a folder of the table it writes.

    It must be the same in every run. A fresh one would restart the batch ids,
    and the sink would take new batches for replays of published ones.
    """
    return checkpoint or table.rstrip("/") + "/_checkpoint"


def run(writer, available_now: bool = True):
    """Start a DataStreamWriter; with ``available_now`` wait until the backlog is processed."""
    if available_now:
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination()
        return q
    return writer.start()


# ---------------------------------------------------------------- S5 source

def read_events(spark: SparkSession, path: str, schema=schemas.INBOUND_MESSAGE,
                max_files: int | None = None) -> DataFrame:
    """Inbound chat messages as JSON files; malformed lines land in
    ``_corrupt_record`` instead of failing the stream."""
    r = (spark.readStream.schema(schema).option("mode", "PERMISSIVE")
         .option("columnNameOfCorruptRecord", "_corrupt_record"))
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.json(path)


# ---------------------------------------------------------------- T1 + T2 intake

def event_seconds() -> Column:
    """``event_ts`` as seconds; null where it is no number."""
    return F.col("event_ts").try_cast("double")


def reject_reason() -> Column:
    """Why a message cannot become a log row, or null: broken JSON, or an
    ``event_ts`` that is missing, no number, or no time of the years 1970 to 9999."""
    at = event_seconds()
    return (F.when(F.col("_corrupt_record").isNotNull(), F.lit("corrupt JSON"))
            .when(at.isNull() | F.isnan(at) | ~at.between(0, 253402300799), F.lit("bad event_ts")))


def intake_rejects(messages: DataFrame) -> DataFrame:
    """The messages ``intake_rows`` cannot take, with the reason."""
    return (messages.withColumn("reject_reason", reject_reason()).where(F.col("reject_reason").isNotNull())
            .select("reject_reason", "event_id", "event_ts", "_corrupt_record"))


def intake_rows(messages: DataFrame, variant: str = "general", dedupe_delay: str | None = "10 minutes",
                event_time: str = "event_time") -> DataFrame:
    """T1 + T2 + F9 + E4 + E5: inbound messages -> log rows.

    Messages that ``reject_reason`` names are left to ``intake_rejects``.
    Retries, bots and edits are dropped, redeliveries of one event id are
    dropped within the watermark (``dropDuplicatesWithinWatermark``); the
    message loses its mentions; a skipped message becomes INFO_RECEIVED.
    Works on batch and streaming frames alike.
    """
    m = messages.where(reject_reason().isNull()).withColumn("route", text.route_messages())
    m = m.where(F.col("route").isin("process", "selection"))
    if dedupe_delay and m.isStreaming:
        m = (m.withColumn(event_time, F.timestamp_seconds(event_seconds()))
             .withWatermark(event_time, dedupe_delay).dropDuplicatesWithinWatermark(["event_id"]))
    elif dedupe_delay:
        m = m.dropDuplicates(["event_id"])
    msg = text.strip_mentions("message")
    reason = text.skip_reason(msg, variant)
    return m.select(
        "event_id", "channel_id", F.coalesce(F.col("thread_ts"), F.col("ts")).alias("thread_ts"), "user_id",
        msg.alias("message"), "category", "route", reason.alias("skip_reason"),
        F.when(reason.isNotNull(), "INFO_RECEIVED").otherwise("INQUIRY").alias("log_type"),
        F.lit("OPEN").alias("status"),
        F.timestamp_seconds(event_seconds()).cast("timestamp_ntz").alias("created_at"))


def intake_stream(spark: SparkSession, source: str, sink: str, checkpoint: str | None = None,
                  variant: str = "general", available_now: bool = True):
    """T1 + S6: append log rows to a Parquet table (file sink, exactly once via its log).

    Messages that cannot be taken go to the table ``<sink>_rejected`` with the
    reason, in a second stream over the same source."""
    rejected = sink.rstrip("/") + "_rejected"
    bad = (intake_rejects(read_events(spark, source)).writeStream.format("parquet").option("path", rejected)
           .option("checkpointLocation", checkpoint_of(rejected, checkpoint and checkpoint.rstrip("/") + "_rejected")).outputMode("append"))
    run(bad, available_now)
    rows = intake_rows(read_events(spark, source), variant)
    w = (rows.writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint_of(sink, checkpoint)).outputMode("append"))
    return run(w, available_now)


# ---------------------------------------------------------------- T3 open tickets

def open_tickets_stream(spark: SparkSession, candidates: DataFrame, tickets_base: str,
                        checkpoint: str | None = None, available_now: bool = True):
    """Each micro-batch opens tickets for threads without one (J4) and adds
    them to the ticket table; of the tickets there it reads thread and id only."""
    def each(batch: DataFrame, batch_id: int):
        if sinks.committed(batch.sparkSession, tickets_base, batch_id):
            return
        # with the log row: messages without a time have no id, and are still tickets of their own
        table = StateTable(batch.sparkSession, tickets_base, ["ticket_id", "log_id"])
        existing = table.read()
        new = lifecycle.open_tickets(batch, None if existing is None else existing.select("thread_ts", "ticket_id"))
        table.upsert(cut_lineage(new), batch_id)
    w = candidates.writeStream.foreachBatch(each).option(
        "checkpointLocation", checkpoint_of(tickets_base, checkpoint))
    return run(w, available_now)


# ---------------------------------------------------------------- T4 feedback

def apply_feedback_stream(spark: SparkSession, feedback: DataFrame, logs_base: str,
                          checkpoint: str | None = None, available_now: bool = True):
    """T4: fold each micro-batch of feedback events into the log state table.

    Of the table's rows the batch reads id and thread, then whole rows of the ids
    it touches, and writes the rows that change. The fold is deterministic in
    (at, seq), so a replayed batch produces the same version."""
    def each(batch: DataFrame, batch_id: int):
        if sinks.committed(batch.sparkSession, logs_base, batch_id):
            return
        table = StateTable(batch.sparkSession, logs_base, ["id"])
        events = cut_lineage(batch)
        narrow = table.read().select("id", "thread_ts")
        threads = events.where(F.col("thread_ts").isNotNull() & (F.col("thread_ts") != "")).select("thread_ts").distinct()
        named = events.select(F.col("log_id").alias("id")).distinct()
        touched = cut_lineage(narrow.join(threads, "thread_ts", "left_semi").select("id").union(narrow.join(named, "id", "left_semi").select("id")))
        before = F.struct("status", "resolved_at")
        folded = lifecycle.apply_feedback_logs(table.read_keys(touched).withColumn("_before", before), events)
        table.upsert(cut_lineage(folded.where(~F.col("_before").eqNullSafe(before)).drop("_before")), batch_id)
    w = feedback.writeStream.foreachBatch(each).option(
        "checkpointLocation", checkpoint_of(logs_base, checkpoint))
    return run(w, available_now)


# ---------------------------------------------------------------- T5 KPIs

def kpi_windows(logs: DataFrame, delay: str = "1 day", period: str = "1 day") -> DataFrame:
    """T5: A6 counters per tumbling event-time window with a watermark."""
    lt = F.col("log_type")
    t = logs.withColumn("event_time", F.col("created_at").cast("timestamp")).withWatermark("event_time", delay)
    tokens = F.col("tokens_input").cast("long") + F.col("tokens_output").cast("long")
    return (t.groupBy(F.window("event_time", period).alias("w"))
            .agg(F.count_if(lt == "INQUIRY").alias("total_inquiries"),
                 F.count_if(lt == "AI_RESPONSE").alias("ai_responses"),
                 F.count_if(F.col("status") == "RESOLVED").alias("resolved"),
                 F.count_if(F.col("status") == "ESCALATED").alias("escalated"),
                 F.sum(F.when(lt == "AI_RESPONSE", tokens)).alias("tokens_sum"),
                 F.count(F.when(lt == "AI_RESPONSE", tokens)).alias("tokens_n"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "total_inquiries", "ai_responses",
                    "resolved", "escalated", "tokens_sum", "tokens_n"))


def kpi_stream(spark: SparkSession, logs: DataFrame, base: str, checkpoint: str | None = None,
               delay: str = "1 day", available_now: bool = True):
    """T5 in update mode: each micro-batch upserts the changed windows."""
    def each(batch: DataFrame, batch_id: int):
        sinks.upsert_batch(batch, batch_id, base, ["window_start"])
    w = (kpi_windows(logs, delay).writeStream.outputMode("update").foreachBatch(each)
         .option("checkpointLocation", checkpoint_of(base, checkpoint)))
    return run(w, available_now)


def kpi_finish(windows: DataFrame) -> DataFrame:
    """Rate and average columns of A6 from the additive window counters."""
    rate = F.round(F.col("resolved").cast("decimal(20,0)") * F.lit(100)
                   / F.nullif(F.col("total_inquiries"), F.lit(0)).cast("decimal(20,0)"), 2).cast("double")
    return windows.select("window_start", "total_inquiries", "ai_responses", "resolved", "escalated",
                          rate.alias("resolution_rate"),
                          F.try_divide(F.col("tokens_sum").cast("double"), F.col("tokens_n")).alias("avg_tokens"))


# ---------------------------------------------------------------- T6 sessions

def conversation_sessions(logs: DataFrame, gap: str = "30 minutes", user_col: str = "user_id") -> DataFrame:
    """Activity sessions per user (start, end = last event + gap, counts).

    A new session starts when an event comes ``gap`` or more after the
    previous one. Positions per user, the previous event by a join on (user,
    position - 1), session numbers as a running sum of session starts; one user
    holding a third of all events is spread over many tasks instead of one.
    """
    minutes = _gap_minutes(gap)
    ev = logs.where(F.col("created_at").isNotNull()).select(user_col, "created_at", "id", "log_type")
    seq = sequence_within(ev, [user_col], ["created_at", "id"], "_pos")
    prev = seq.select(F.col(user_col).alias("_pu"), (F.col("_pos") + 1).alias("_pp"),
                      F.col("created_at").alias("_prev"))
    j = seq.join(prev, (F.col(user_col).eqNullSafe(F.col("_pu"))) & (F.col("_pos") == F.col("_pp")), "left")
    start = F.col("_prev").isNull() | (F.col("created_at") >= F.timestamp_add("MINUTE", F.lit(minutes), F.col("_prev")))
    j = j.select(user_col, "created_at", "id", "log_type", F.when(start, 1).otherwise(0).alias("_start"))
    numbered = running_sum_within(j, [user_col], ["created_at", "id"], "_start", "_session")
    return (numbered.groupBy(user_col, "_session")
            .agg(F.min("created_at").alias("session_start"),
                 F.timestamp_add("MINUTE", F.lit(minutes), F.max("created_at")).alias("session_end"),
                 F.count(F.lit(1)).alias("events"),
                 F.count_if(F.col("log_type") == "INQUIRY").alias("inquiries"))
            .drop("_session"))


SESSION = "session_start timestamp_ntz, session_end timestamp_ntz, events long, inquiries long"


def session_stream(spark: SparkSession, logs: DataFrame, base: str, gap: str = "30 minutes", delay: str = "1 hour",
                   checkpoint: str | None = None, available_now: bool = True):
    """T6 over a stream: a session is published as closed, once, when the latest
    event time less ``delay`` has reached its end; open ones are published apart.

    State is the open sessions only. A micro-batch is cut into sessions by the
    batch form first, so a busy user reaches the merge as a few intervals. An
    event older than the mark of the batches before it is late and left out;
    ``closed_sessions`` and ``open_sessions`` read the results.
    """
    def each(batch: DataFrame, batch_id: int):
        session = batch.sparkSession
        if sinks.committed(session, base, batch_id):
            return
        table = StateTable(session, base, ["user_id"])
        at = F.unix_micros(F.col("created_at").cast("timestamp"))
        before = table.extra().get("watermark_us")
        events = cut_lineage(batch.select("id", "user_id", "created_at", "log_type").where(F.col("created_at").isNotNull())
                             .where(F.lit(True) if before is None else at >= F.lit(before)))
        newest = events.agg(F.max(at)).first()[0]
        waits = F.expr(f"interval {delay}")
        if newest is not None:
            newest = session.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(newest)) - waits)).first()[0]
        mark = max((x for x in (before, newest) if x is not None), default=None)
        new = conversation_sessions(events, gap)
        state = table.read()
        held = None if state is None else state.where(F.size("open") > 0).select("user_id", F.inline("open"))
        both = new if held is None else new.unionByName(held)
        merged = cut_lineage(merge_sessions(both).withColumn("closed", F.unix_micros(F.col("session_end").cast("timestamp")) <= F.lit(mark).cast("long")))
        sinks.write_part(merged.where("closed").drop("closed"), base.rstrip("/") + "_closed", batch_id)
        still = (merged.groupBy("user_id").agg(F.array_sort(F.collect_list(F.when(~F.col("closed"), F.struct(
            "session_start", "session_end", "events", "inquiries")))).alias("open")))
        table.upsert(still, batch_id, extra={"watermark_us": mark})
    w = logs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_of(base, checkpoint))
    return run(w, available_now)


def merge_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions of a user that overlap become one. The rows of a user are the
    intervals of one batch and the open ones, at least a gap apart in each."""
    order = Window.partitionBy("user_id").orderBy("session_start", "session_end")
    reach = F.max("session_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = sessions.withColumn("_starts", F.when(reach.isNull() | (F.col("session_start") >= reach), 1).otherwise(0))
    numbered = marked.withColumn("_no", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "_no").agg(
        F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"), F.sum("events").alias("events"),
        F.sum("inquiries").alias("inquiries")).drop("_no")


def closed_sessions(spark: SparkSession, base: str) -> DataFrame:
    return sinks.read_parts(spark, base.rstrip("/") + "_closed", sinks.current_version(spark, base), "user_id string, " + SESSION)


def open_sessions(spark: SparkSession, base: str) -> DataFrame:
    state = sinks.read_current(spark, base)
    if state is None:
        return spark.createDataFrame([], "user_id string, " + SESSION)
    return state.select("user_id", F.inline("open"))


def _gap_minutes(gap: str) -> int:
    num, unit = gap.split()
    return int(num) * {"minute": 1, "minutes": 1, "hour": 60, "hours": 60}[unit.lower()]


# ---------------------------------------------------------------- T7 SLA timers

SLA_OUT = "ticket_id string, kind string, due_at timestamp, urgency string"
SLA_STATE = "ticket_id string, opened timestamp, urgency string, stage string"
DONE_KEPT = "90 days"  # how long a breached ticket that nobody closes is remembered


def sla_notices(spark: SparkSession, base: str) -> DataFrame:
    """The warning and breach notices published so far."""
    return sinks.read_parts(spark, base.rstrip("/") + "_notices", sinks.current_version(spark, base), SLA_OUT)


def sla_time(opened: str, urgency: str, share: float) -> Column:
    """When ``share`` of the SLA of a ticket opened then has passed."""
    hours = F.coalesce(*[F.when(F.col(urgency) == u, h) for u, h in sla.SLA_HOURS.items()], F.lit(sla.DEFAULT_SLA_HOURS))
    return F.timestamp_micros(F.unix_micros(opened) + (hours * F.lit(sla.HOUR_MS * 1000) * F.lit(share)).cast("long"))


def reduced_events(events: DataFrame) -> DataFrame:
    """(ticket_id, closed, opened, urgency) per ticket: whether the batch closes
    it, and its first open event after the last closing one.

    Two partial aggregates and a join on a wrapped key, so a ticket that holds
    a third of the rows is combined before the exchange or split.
    """
    at = F.struct("event_time", "seq")
    done = F.col("status").isin("RESOLVED", "CLOSED")
    last = (events.where(done).groupBy(F.struct("ticket_id").alias("k")).agg(F.max(at).alias("last"))
            .select(F.col("k.ticket_id").alias("ticket_id"), "last"))
    opened = (events.where(~F.coalesce(done, F.lit(False))).join(last, "ticket_id", "left").where(F.col("last").isNull() | (at > F.col("last")))
              .groupBy("ticket_id").agg(F.min("event_time").alias("opened"), F.min_by("urgency", at).alias("urgency")))
    return last.select("ticket_id", F.lit(True).alias("closed")).join(opened, "ticket_id", "full").select(
        "ticket_id", F.coalesce("closed", F.lit(False)).alias("closed"), "opened", "urgency")


def sla_breach_stream(spark: SparkSession, ticket_events: DataFrame, base: str, delay: str = "10 minutes", done_kept: str = DONE_KEPT,
                      checkpoint: str | None = None, available_now: bool = True):
    """Warning and breach notices from ticket events, by event time.

    ``ticket_events``: ticket_id, urgency, status, at (timestamp_ntz), seq. A
    ticket's first open event arms a warning at 75 % of its SLA and a breach at
    the deadline; a RESOLVED or CLOSED event disarms both and lets a later open
    event start anew. A notice is given once, when the latest event time less
    ``delay`` has reached its time. A ticket that was breached stays so until it
    is closed, or for ``done_kept`` after its deadline.

    The tickets' stages are a state table, updated by joins: no ticket's events
    pass through one task's memory. Rows without ticket or time take no part.
    """
    def each(batch: DataFrame, batch_id: int):
        session = batch.sparkSession
        if sinks.committed(session, base, batch_id):
            return
        table = StateTable(session, base, ["ticket_id"])
        events = cut_lineage(batch.withColumn("event_time", F.col("at").cast("timestamp")).where(F.col("ticket_id").isNotNull() & F.col("event_time").isNotNull())
                             .select("ticket_id", "urgency", "status", "event_time", "seq"))
        before = table.extra().get("watermark_us")
        newest = events.agg(F.unix_micros(F.max("event_time") - F.expr(f"interval {delay}"))).first()[0]
        mark = max((x for x in (before, newest) if x is not None), default=None)
        state = table.read()
        state = session.createDataFrame([], SLA_STATE) if state is None else state
        old = state.select("ticket_id", F.col("opened").alias("o_opened"), F.col("urgency").alias("o_urgency"), F.col("stage").alias("o_stage"))
        both = old.join(reduced_events(events), "ticket_id", "full")
        now, was_now = (F.timestamp_micros(F.lit(x).cast("long")) for x in (mark, before))
        forgotten = (F.col("o_stage") == "done") & (sla_time("o_opened", "o_urgency", 1.0) + F.expr(f"interval {done_kept}") <= was_now)
        kept = F.col("o_stage").isNotNull() & (F.col("o_stage") != "closed") & ~F.coalesce("closed", F.lit(False)) & ~F.coalesce(forgotten, F.lit(False))
        armed = (both.select("ticket_id", F.when(kept, F.col("o_opened")).otherwise(F.col("opened")).alias("opened"),
                             F.when(kept, F.col("o_urgency")).otherwise(F.col("urgency")).alias("urgency"),
                             F.when(kept, F.col("o_stage")).when(F.col("opened").isNotNull(), "armed").otherwise("closed").alias("was"),
                             "o_opened", "o_urgency", "o_stage")
                 .withColumn("due_at", sla_time("opened", "urgency", 1.0)).withColumn("warn_at", sla_time("opened", "urgency", 1 - sla.WARNING_SHARE)))
        stage = (F.when(F.col("was").isin("armed", "warned") & (F.col("due_at") <= now), "done")
                 .when((F.col("was") == "armed") & (F.col("warn_at") <= now), "warned").otherwise(F.col("was")))
        moved = cut_lineage(armed.withColumn("stage", stage))
        told = [moved.where((F.col("was") == "armed") & F.col("stage").isin("warned", "done")).withColumn("kind", F.lit("warning")),
                moved.where(F.col("was").isin("armed", "warned") & (F.col("stage") == "done")).withColumn("kind", F.lit("breach"))]
        sinks.write_part(told[0].union(told[1]).select("ticket_id", "kind", "due_at", "urgency"), base.rstrip("/") + "_notices", batch_id)
        changed = moved.where(~F.struct("opened", "urgency", "stage").eqNullSafe(F.struct("o_opened", "o_urgency", "o_stage")))
        table.upsert(changed.select("ticket_id", "opened", "urgency", "stage"), batch_id, extra={"watermark_us": mark})
    w = ticket_events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_of(base, checkpoint))
    return run(w, available_now)


# ---------------------------------------------------------------- T8 urgent alerts

URGENT_TEXT = "緊急チケット: "  # fixed value chosen for the outbox text


def urgent_alerts(tickets: DataFrame, default_channel: str = "") -> DataFrame:
    """HIGH-urgency active tickets -> outbox rows (channel, text)."""
    t = tickets.where((F.col("urgency") == "HIGH") & F.col("status").isin(*kpi.ACTIVE))
    return t.select("ticket_id", lifecycle.resolve_channel("source_channel", default_channel).alias("channel"),
                    F.concat(F.lit(URGENT_TEXT), F.col("ticket_id"), F.lit(" "),
                             F.coalesce(F.col("summary"), F.lit(""))).alias("text"), "created_at")


# ---------------------------------------------------------------- S4 export

def export_incremental(spark: SparkSession, source: DataFrame, base: str, keys: list[str],
                       order_col: str = "updated_at", checkpoint: str | None = None,
                       available_now: bool = True):
    """Scheduled incremental export; each run (availableNow) upserts the
    rows that arrived since the last run into the snapshot table."""
    def each(batch: DataFrame, batch_id: int):
        StateTable(batch.sparkSession, base, keys, order_col).upsert(batch, batch_id)
    w = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_of(base, checkpoint))
    return run(w, available_now)
