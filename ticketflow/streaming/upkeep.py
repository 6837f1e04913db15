"""Aggregates kept up to date by what changes, and numbers that go on over batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketflow.functions.timeutil import day_start, minute_boundaries
from ticketflow.operators import lifecycle
from ticketflow.session import cut_lineage
from ticketflow.streaming import sinks
from ticketflow.streaming.jobs import checkpoint_of, run
from ticketflow.streaming.state_table import StateTable

DAY_KEYS = ["ticket_date", "category", "priority"]
DAY_SUMS = ["ticket_count", "open_count", "resolved_count", "minutes_sum", "minutes_n"]


def contributions(tickets: DataFrame, sign: int) -> DataFrame:
    """What each ticket adds to its day's sums (A1), times ``sign``."""
    minutes = F.when(F.col("resolved_at").isNotNull(), minute_boundaries(F.col("created_at"), F.col("resolved_at")))
    flag = lambda c: F.coalesce(c.cast("long"), F.lit(0))
    values = [F.lit(1), flag(F.col("status") == "OPEN"), flag(F.col("status") == "RESOLVED"), F.coalesce(minutes, F.lit(0)), flag(minutes.isNotNull())]
    return tickets.select(day_start("created_at").alias("ticket_date"), "category", "priority",
                          *[(v.cast("long") * F.lit(sign)).alias(n) for v, n in zip(values, DAY_SUMS)])


def summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*DAY_KEYS).agg(*[F.sum(c).alias(c) for c in DAY_SUMS])


def keep_daily_stats(changed: DataFrame, batch_id: int, tickets_base: str, days_base: str) -> None:
    """A1 and its ticket table after a batch of changed tickets (whole rows with
    ``updated_at``; the newest row per ticket wins).

    A ticket that changes takes its stored contribution out and adds the new one,
    so a batch reads the tickets and days it touches and writes these alone. The
    days are published first: a batch that is replayed in between finds them done
    and only catches up on the tickets.
    """
    spark = changed.sparkSession
    tickets, days = StateTable(spark, tickets_base, ["ticket_id"], "updated_at"), StateTable(spark, days_base, DAY_KEYS)
    new = cut_lineage(tickets.newest(changed))
    if not sinks.committed(spark, days_base, batch_id):
        old = tickets.read_keys(new)
        if old is None:
            parts = contributions(new, 1)
        else:
            stored = old.select("ticket_id", F.col("updated_at").alias("_stored_at"))
            wins = new.join(stored, "ticket_id", "left").where(F.col("_stored_at").isNull() | (F.col("updated_at") >= F.col("_stored_at"))).drop("_stored_at")
            parts = contributions(wins, 1).unionByName(contributions(old.join(wins.select("ticket_id"), "ticket_id", "left_semi"), -1))
        delta = cut_lineage(summed(parts).where(" or ".join(f"{c} <> 0" for c in DAY_SUMS)))
        stored_days = days.read_keys(delta)
        days.upsert(cut_lineage(summed(delta if stored_days is None else delta.unionByName(stored_days))), batch_id)
    tickets.upsert(new, batch_id)


def daily_stats(spark: SparkSession, days_base: str) -> DataFrame:
    """A1 as kept: days without tickets left are not given."""
    days = sinks.read_current(spark, days_base)
    return days.where(F.col("ticket_count") > 0).select(
        *DAY_KEYS, "ticket_count", "open_count", "resolved_count",
        F.try_divide(F.col("minutes_sum").cast("double"), F.col("minutes_n")).alias("avg_resolution_minutes"))


def daily_stats_stream(spark: SparkSession, changed: DataFrame, tickets_base: str, days_base: str,
                       checkpoint: str | None = None, available_now: bool = True):
    """``keep_daily_stats`` for every micro-batch of a stream of changed tickets."""
    def each(batch: DataFrame, batch_id: int):
        keep_daily_stats(batch, batch_id, tickets_base, days_base)
    w = changed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_of(tickets_base, checkpoint))
    return run(w, available_now)


def create_tickets_batch(requests: DataFrame, batch_id: int, base: str, prefix: str = "TKT-") -> None:
    """R2 over batches: ticket numbers go on after the last one published.

    The high-water mark is published with the batch in one step, so a batch that
    is replayed before that takes the same numbers, one replayed after it does
    nothing, and no two batches share a number. Actions are appended beside it.
    """
    spark = requests.sparkSession
    if sinks.committed(spark, base, batch_id):
        return
    table = StateTable(spark, base, ["ticket_id", "request_id"])  # a request without a time has no id
    last = table.extra().get("last_number", 0)
    tickets, _ = lifecycle.create_tickets(requests, prefix, last)
    tickets = cut_lineage(tickets)
    sinks.write_part(lifecycle.created_actions(tickets), base.rstrip("/") + "_actions", batch_id)
    table.upsert(tickets, batch_id, extra={"last_number": last + tickets.count()})


def created_actions(spark: SparkSession, base: str) -> DataFrame:
    """The CREATED actions of the batches published so far."""
    return sinks.read_parts(spark, base.rstrip("/") + "_actions", sinks.current_version(spark, base), lifecycle.ACTION_SCHEMA)
