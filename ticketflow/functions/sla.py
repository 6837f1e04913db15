"""SLA state and formatting (E1 ``sla_state``, E2 ``format_sla``, J9 ``sla_lookup``).

All clock reads are replaced by an explicit ``as_of`` so a result is a pure
function of its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketflow.functions.timeutil import col_of, epoch_millis, lit_ts

# SLA hours per urgency, the fallback, the warning share and UI labels.
SLA_HOURS = {"HIGH": 2, "MEDIUM": 8, "LOW": 24}
DEFAULT_SLA_HOURS = 8
WARNING_SHARE = 0.25
LABEL_DONE = "完了"
LABEL_OVERDUE = "SLA超過"
LABEL_REMAINING = "残り"
LABEL_HOURS = "時間"
LABEL_BUSINESS_DAYS = "営業日"
SLA_SETTING_KEYS = {"HIGH": "sla_high", "MEDIUM": "sla_medium", "LOW": "sla_low"}

HOUR_MS = 3_600_000
MINUTE_MS = 60_000


def sla_hours_of(urgency) -> Column:
    """Hours for an urgency; unknown or null urgency falls back to 8."""
    u = col_of(urgency)
    m = F.create_map(*[x for k, v in SLA_HOURS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, u), F.lit(DEFAULT_SLA_HOURS))


def sla_state(df: DataFrame, as_of, hours_col: str | None = None,
              created_col: str = "created_at", urgency_col: str = "urgency",
              status_col: str = "status") -> DataFrame:
    """Add SLA columns as of ``as_of``.

    state: done (RESOLVED/CLOSED), overdue (remaining < 0), warning
    (0 < remaining < 25% of the SLA), else normal; exactly 0 is normal.
    remaining_h / remaining_m reproduce the display arithmetic (floor, then
    a dividend-signed remainder), so 30 minutes late shows 1h30m;
    ``overdue_minutes`` is the true lateness.
    """
    hours = F.col(hours_col) if hours_col else sla_hours_of(urgency_col)
    now = epoch_millis(lit_ts(as_of))
    created = epoch_millis(created_col)
    total = hours.cast("long") * F.lit(HOUR_MS)
    remaining = created + total - now
    elapsed = now - created
    done = col_of(status_col).isin("RESOLVED", "CLOSED")
    overdue = remaining < 0
    warning = (remaining > 0) & (remaining < total * F.lit(WARNING_SHARE))
    rem_h = F.floor(remaining / F.lit(HOUR_MS))
    rem_m = F.floor((remaining % F.lit(HOUR_MS)) / F.lit(MINUTE_MS))
    progress = F.when(overdue, F.lit(100.0)).otherwise(
        F.least(F.lit(100.0), elapsed / total * F.lit(100.0)))
    text = F.when(overdue, F.concat(F.lit(LABEL_OVERDUE + " "), F.abs(rem_h).cast("string"),
                                    F.lit("h"), F.abs(rem_m).cast("string"), F.lit("m"))
                  ).otherwise(F.concat(F.lit(LABEL_REMAINING + " "), rem_h.cast("string"),
                                       F.lit("h"), rem_m.cast("string"), F.lit("m")))

    def live(c):
        return F.when(~done, c)

    return df.select(
        "*",
        hours.alias("sla_hours"),
        F.when(done, "done").when(overdue, "overdue").when(warning, "warning")
         .otherwise("normal").alias("sla_state"),
        live(remaining).alias("remaining_ms"),
        live(rem_h).alias("remaining_h"),
        live(rem_m).alias("remaining_m"),
        live(progress).alias("progress_pct"),
        F.when(done, F.lit(LABEL_DONE)).otherwise(text).alias("sla_text"),
        F.when(~done & overdue, F.floor(-remaining / F.lit(MINUTE_MS))).alias("overdue_minutes"),
    )


def format_sla(hours) -> Column:
    """< 24 -> 'N時間', else round(N/24) business days (JS Math.round: half up)."""
    h = col_of(hours)
    days = F.floor(h / F.lit(24.0) + F.lit(0.5)).cast("long")
    return F.when(h < 24, F.concat(h.cast("string"), F.lit(LABEL_HOURS))) \
            .otherwise(F.concat(days.cast("string"), F.lit(LABEL_BUSINESS_DAYS)))


def sla_lookup(tickets: DataFrame, settings: DataFrame, urgency_col: str = "urgency") -> DataFrame:
    """SLA hours per ticket read from settings (sla_high/medium/low).

    The settings side is first reduced to at most three rows (one per SLA
    key, groupBy on the key) so the broadcast is bounded by construction.
    Missing or non-numeric settings fall back to the built-in constants,
    then to 8.
    """
    keys = F.create_map(*[x for k, v in SLA_SETTING_KEYS.items() for x in (F.lit(v), F.lit(k))])
    hours = (settings.where(F.col("setting_key").isin(*SLA_SETTING_KEYS.values()))
             .select("id", F.try_element_at(keys, F.col("setting_key")).alias("_sla_urgency"),
                     F.nullif(F.regexp_extract("setting_value", r"^\s*([+-]?\d+)", 1), F.lit(""))
                      .try_cast("int").alias("_v"))
             .groupBy("_sla_urgency")
             .agg(F.min_by("_v", "id").alias("_set_hours")))
    joined = tickets.join(F.broadcast(hours), F.col(urgency_col) == F.col("_sla_urgency"), "left")
    return joined.withColumn(
        "sla_hours", F.coalesce(F.col("_set_hours"), sla_hours_of(urgency_col))
    ).drop("_sla_urgency", "_set_hours")
