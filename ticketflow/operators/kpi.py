"""Ticket and log KPIs.

Every aggregate is a single ``groupBy().agg`` so Catalyst plans a partial
(map-side) HashAggregate, one shuffle on the grouping keys, and a final
HashAggregate. Global aggregates (no keys) shuffle only one partial row per
input partition. Conditional counts use ``count_if`` / ``sum(when)`` inside
the same pass instead of separate scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketflow.functions.skew import sequence_within
from ticketflow.functions.timeutil import (day_start, hours_between, lit_date,
                                           minute_boundaries)

DONE = ("RESOLVED", "CLOSED")
ACTIVE = ("OPEN", "IN_PROGRESS", "HUMAN_REQUESTED")


def _flag_sum(cond):
    """SUM(CASE WHEN cond THEN 1 ELSE 0 END): NULL on empty input, like SQL."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("long")


def ticket_stats_daily(tickets: DataFrame, keys=("category", "priority"),
                       date_col: str = "created_at") -> DataFrame:
    """A1: per day and keys: count, OPEN, RESOLVED, avg resolution minutes.

    Minutes count minute boundaries crossed (warehouse TIMESTAMPDIFF), and
    only rows with a resolved_at contribute to the average.
    """
    mins = F.when(F.col("resolved_at").isNotNull(),
                  minute_boundaries(F.col(date_col), F.col("resolved_at")))
    return (tickets
            .groupBy(day_start(date_col).alias("ticket_date"), *keys)
            .agg(F.count(F.lit(1)).alias("ticket_count"),
                 F.count_if(F.col("status") == "OPEN").alias("open_count"),
                 F.count_if(F.col("status") == "RESOLVED").alias("resolved_count"),
                 F.avg(mins).alias("avg_resolution_minutes")))


def ticket_stats_by(tickets: DataFrame, keys=("department", "category"),
                    priority_col: str = "priority", high_name: str = "high_priority_count",
                    prefix: str = "") -> DataFrame:
    """A2/A3: per keys: total, OPEN, HIGH count, last created_at."""
    return (tickets.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias(f"{prefix}total_tickets"),
                 F.count_if(F.col("status") == "OPEN").alias(f"{prefix}open_tickets"),
                 F.count_if(F.col(priority_col) == "HIGH").alias(high_name),
                 F.max("created_at").alias("last_ticket_at")))


def ticket_stats_by_department(tickets: DataFrame) -> DataFrame:
    """A2: by department and category."""
    return ticket_stats_by(tickets, ("department", "category"), "priority", "high_priority_count")


def ticket_stats_by_location(tickets: DataFrame) -> DataFrame:
    """A3: by location and issue_type, HIGH counted on urgency."""
    return ticket_stats_by(tickets, ("location", "issue_type"), "urgency", "high_urgency_count")


def ticket_kpi_summary(tickets: DataFrame, as_of) -> DataFrame:
    """A4: one row. Empty input gives total 0 and NULL sums, as SQL does."""
    today = lit_date(as_of)
    mins = F.when(F.col("resolved_at").isNotNull(),
                  minute_boundaries(F.col("created_at"), F.col("resolved_at")))
    return tickets.agg(
        F.count(F.lit(1)).alias("total_tickets"),
        _flag_sum(F.to_date("created_at") == today).alias("today_tickets"),
        _flag_sum(F.col("status") == "OPEN").alias("open_tickets"),
        _flag_sum(F.col("status") == "IN_PROGRESS").alias("in_progress_tickets"),
        _flag_sum(F.col("status") == "RESOLVED").alias("resolved_tickets"),
        _flag_sum(F.col("category") == "HARDWARE").alias("hardware_tickets"),
        _flag_sum(F.col("category") == "SOFTWARE").alias("software_tickets"),
        _flag_sum(F.col("priority") == "HIGH").alias("high_priority_tickets"),
        F.avg(mins).alias("avg_resolution_minutes"))


def today_open_counts(tickets: DataFrame, as_of) -> DataFrame:
    """today's tickets and open tickets (subset of A4)."""
    return ticket_kpi_summary(tickets, as_of).select("today_tickets", "open_tickets")


def v_ticket_summary(tickets: DataFrame) -> DataFrame:
    """A5: per date, status, issue_type, urgency: count, avg fractional hours."""
    return (tickets.groupBy(F.to_date("created_at").alias("date"), "status", "issue_type", "urgency")
            .agg(F.count(F.lit(1)).alias("ticket_count"),
                 F.avg(hours_between("created_at", "resolved_at")).alias("avg_resolution_hours")))


def v_daily_kpi(logs: DataFrame) -> DataFrame:
    """Per log date: inquiries, AI responses, RESOLVED rows, ESCALATED rows,
    resolution rate, average tokens of AI rows.

    The rate divides RESOLVED rows of every log type by INQUIRY rows and is
    computed in decimal, rounded half-up to 2 places (PostgreSQL NUMERIC), so
    it can exceed 100. ``tokens_input + tokens_output`` is NULL if either is.
    """
    lt = F.col("log_type")
    resolved = F.count_if(F.col("status") == "RESOLVED")
    inquiries = F.count_if(lt == "INQUIRY")
    rate = F.round(resolved.cast("decimal(20,0)") * F.lit(100)
                   / F.nullif(inquiries, F.lit(0)).cast("decimal(20,0)"), 2).cast("double")
    tokens = F.col("tokens_input").cast("long") + F.col("tokens_output").cast("long")
    return (logs.groupBy(F.to_date("created_at").alias("date"))
            .agg(inquiries.alias("total_inquiries"),
                 F.count_if(lt == "AI_RESPONSE").alias("ai_responses"),
                 resolved.alias("resolved"),
                 F.count_if(F.col("status") == "ESCALATED").alias("escalated"),
                 rate.alias("resolution_rate"),
                 F.avg(F.when(lt == "AI_RESPONSE", tokens)).alias("avg_tokens")))


def asset_stats(assets: DataFrame, repair_status: str = "MAINTENANCE") -> DataFrame:
    """Per asset type count, plus total and repair count of the whole table.

    One scan: a grouped aggregate per type (a handful of rows), then the
    totals as window sums over that tiny result. The list filters of the
    listing do not apply here, as in the reference.
    """
    by_type = assets.groupBy("asset_type").agg(
        F.count(F.lit(1)).alias("asset_count"),
        F.count_if(F.col("status") == repair_status).alias("_repair"))
    everything = Window.partitionBy()
    return by_type.select(
        "asset_type", "asset_count",
        F.sum("asset_count").over(everything).alias("total_assets"),
        F.sum("_repair").over(everything).alias("repair_count"))


def distribution(tickets: DataFrame, column: str = "status") -> DataFrame:
    """Count per value and its share of all rows."""
    counts = tickets.groupBy(column).agg(F.count(F.lit(1)).alias("ticket_count"))
    return counts.withColumn(
        "share", F.col("ticket_count") / F.sum("ticket_count").over(Window.partitionBy()))


def top_issue_types(tickets: DataFrame, k: int = 10, column: str = "issue_type") -> DataFrame:
    """The k most frequent issue types, ties broken by the key (TakeOrderedAndProject)."""
    return (tickets.groupBy(column).agg(F.count(F.lit(1)).alias("ticket_count"))
            .orderBy(F.desc("ticket_count"), F.asc(column)).limit(k))


def trend_days(tickets: DataFrame, as_of, days: int = 7) -> DataFrame:
    """A10: created and resolved counts for as_of-(days-1) .. as_of, zero filled.

    Both counts come from one scan: each ticket yields its created day and
    its resolved day, filtered to the window before the aggregate. The
    day spine is generated with ``sequence`` and left-joined.
    """
    end = lit_date(as_of)
    start = F.date_sub(end, days - 1)
    spark = tickets.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(start, end)).alias("date"))
    events = tickets.select(
        F.explode(F.array(
            F.struct(F.to_date("created_at").alias("day"), F.lit(1).alias("c"), F.lit(0).alias("r")),
            F.struct(F.to_date("resolved_at").alias("day"), F.lit(0).alias("c"), F.lit(1).alias("r")),
        )).alias("e")).select("e.*").where(F.col("day").between(start, end))
    counts = events.groupBy("day").agg(F.sum("c").cast("long").alias("created"),
                                       F.sum("r").cast("long").alias("resolved"))
    return (spine.join(counts, spine.date == counts.day, "left")
            .select("date", F.coalesce("created", F.lit(0)).alias("created"),
                    F.coalesce("resolved", F.lit(0)).alias("resolved")))


# Unit labels of the resolution summary.
LABEL_HOURS = "時間"
LABEL_DAYS = "日"


def resolution_summary(tickets: DataFrame) -> DataFrame:
    """Total, resolved (RESOLVED/CLOSED), rate to one decimal ('0' if none),
    open = total - resolved, average hours over rows with resolved_at (any
    status), and the text form: hours below 24, else days, 'N/A' if none.
    """
    agg = tickets.agg(
        F.count(F.lit(1)).alias("total_tickets"),
        F.count_if(F.col("status").isin(*DONE)).alias("resolved_tickets"),
        F.avg(F.when(F.col("resolved_at").isNotNull(),
                     hours_between("created_at", "resolved_at"))).alias("avg_resolution_hours"))
    t, r, h = F.col("total_tickets"), F.col("resolved_tickets"), F.col("avg_resolution_hours")
    return agg.select(
        t, r,
        F.when(t > 0, F.format_string("%.1f", r / t * 100.0)).otherwise(F.lit("0"))
         .alias("resolution_rate"),
        (t - r).alias("open_tickets"), h,
        F.when(h.isNull(), F.lit("N/A"))
         .when(h < 24, F.concat(F.format_string("%.1f", h), F.lit(LABEL_HOURS)))
         .otherwise(F.concat(F.format_string("%.1f", h / 24.0), F.lit(LABEL_DAYS)))
         .alias("avg_resolution_text"))


def queue_stats(tickets: DataFrame) -> DataFrame:
    """Total; open = OPEN or HUMAN_REQUESTED; in progress; HIGH among active.

    Computed on the whole filtered set, not one page.
    """
    st = F.col("status")
    return tickets.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(st.isin("OPEN", "HUMAN_REQUESTED")).alias("open"),
        F.count_if(st == "IN_PROGRESS").alias("in_progress"),
        F.count_if(st.isin(*ACTIVE) & (F.col("urgency") == "HIGH")).alias("high_urgency"))


def bump_counter(articles: DataFrame, view_events: DataFrame, id_col: str = "id",
                 event_key: str = "article_id") -> DataFrame:
    """views = views + number of view events per article.

    Events are pre-aggregated per article (partial aggregate before the
    shuffle), so a hot article costs one row per map task, not one per view.
    """
    counts = view_events.groupBy(event_key).agg(F.count(F.lit(1)).alias("_new_views"))
    return (articles.join(counts, articles[id_col] == counts[event_key], "left")
            .withColumn("views", F.col("views").cast("long") + F.coalesce("_new_views", F.lit(0)))
            .drop(event_key, "_new_views"))


def view_leaderboard(articles: DataFrame, view_events: DataFrame, k: int | None = None) -> DataFrame:
    """Articles by views descending (after P7), ties by id."""
    out = bump_counter(articles, view_events).select("id", "category", "views")
    out = out.orderBy(F.desc("views"), F.asc("id"))
    return out.limit(k) if k else out


def feedback_quality(articles: DataFrame, key: str = "category") -> DataFrame:
    """Helpful / not-helpful / view counters per key and the helpful ratio."""
    h = F.sum(F.col("helpful").cast("long"))
    nh = F.sum(F.col("not_helpful").cast("long"))
    return articles.groupBy(key).agg(
        F.count(F.lit(1)).alias("articles"),
        h.alias("helpful"), nh.alias("not_helpful"),
        F.sum(F.col("views").cast("long")).alias("views"),
        F.try_divide(h.cast("double"), (h + nh).cast("double")).alias("helpful_ratio"))


def exact_percentiles(df: DataFrame, key: str, value: str, id_col: str, shares: dict[str, float]) -> DataFrame:
    """One row per key: the interpolated percentiles of ``value``, named by ``shares``.

    Values are numbered within their key by the skew-safe sequence, and only the
    two rows around each wanted position are kept: no group is collected and no
    sketch approximates. Nulls do not count; ``id_col`` breaks ties.
    """
    rows = df.select(key, value, id_col).where(F.col(value).isNotNull())
    seq = sequence_within(rows, [key], [value, id_col], "_pos")
    sizes = (rows.groupBy(F.struct(key).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
             .select(F.col(f"_g.{key}").alias("_k"), "_n"))
    at = {name: 1 + (F.col("_n") - 1) * F.lit(share) for name, share in shares.items()}  # 1-based, between two rows
    wanted = F.array(*[x.cast("long") for h in at.values() for x in (F.floor(h), F.ceil(h))])
    near = seq.join(sizes, F.col(key).eqNullSafe(F.col("_k"))).where(F.array_contains(wanted, F.col("_pos")))
    return near.groupBy(key).agg(*[
        (F.max(F.when(F.col("_pos") == F.floor(h), F.col(value))) * (1 - (F.max(h) - F.floor(F.max(h))))
         + F.max(F.when(F.col("_pos") == F.ceil(h), F.col(value))) * (F.max(h) - F.floor(F.max(h)))).alias(name)
        for name, h in at.items()])


def ai_quality(responses: DataFrame, key: str, id_col: str = "response_id") -> DataFrame:
    """AI response quality: mean confidence, helpful and escalation rates,
    mean and exact p50/p95 response time.

    Input columns: confidence_score, was_helpful, response_time_ms, escalated, and
    an id that breaks ties.
    """
    means = responses.groupBy(key).agg(
        F.count(F.lit(1)).alias("responses"),
        F.avg("confidence_score").alias("avg_confidence"),
        F.avg(F.col("was_helpful").cast("double")).alias("helpful_rate"),
        F.avg(F.col("escalated").cast("double")).alias("escalation_rate"),
        F.avg("response_time_ms").alias("avg_response_ms"))
    parts = exact_percentiles(responses, key, "response_time_ms", id_col, {"p50_response_ms": 0.5, "p95_response_ms": 0.95})
    parts = parts.withColumnRenamed(key, "_pk")
    return means.join(parts, F.col(key).eqNullSafe(F.col("_pk")), "left").drop("_pk")


def column_profile(tables: dict) -> DataFrame:
    """Per table and column: position, row count, null count, distinct count.

    Each table is read once and turned to (column, value) rows; values are
    deduplicated per column before the shuffle, long ones as their hash. Equal
    values of a column therefore meet in one task as one row per map task.
    """
    out = None
    for name, df in tables.items():
        cells = df.select(F.inline(F.array(*[
            F.struct(F.lit(i + 1).alias("ordinal"), F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v"))
            for i, c in enumerate(df.columns)])))
        v = F.when(F.length("v") > 64, F.sha2("v", 256)).otherwise(F.col("v")).alias("v")
        counted = cells.select("ordinal", "column_name", v).groupBy("ordinal", "column_name", "v").agg(F.count(F.lit(1)).alias("n"))
        prof = counted.groupBy("ordinal", "column_name").agg(
            F.sum("n").alias("row_count"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
            F.count("v").alias("distinct_count"))
        prof = prof.select(F.lit(name).alias("table_name"), "row_count", "ordinal", "column_name", "null_count", "distinct_count")
        out = prof if out is None else out.unionByName(prof)
    return out
