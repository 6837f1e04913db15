"""Time-zone independent arithmetic on ``timestamp_ntz`` columns.

The reference stores zone-less timestamps. Epoch offsets are taken against
an NTZ epoch literal so results never depend on the session time zone.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ntz(c) -> Column:
    return col_of(c).cast("timestamp_ntz")


def epoch_millis(c) -> Column:
    return F.timestamp_diff("MILLISECOND", _epoch(), ntz(c))


def epoch_micros(c) -> Column:
    return F.timestamp_diff("MICROSECOND", _epoch(), ntz(c))


def minute_boundaries(start, end) -> Column:
    """Minute boundaries crossed from start to end (warehouse TIMESTAMPDIFF).

    00:59:30 -> 01:01:10 gives 2, where whole elapsed minutes would give 1.
    """
    return (F.floor(epoch_micros(end) / F.lit(60_000_000))
            - F.floor(epoch_micros(start) / F.lit(60_000_000)))


def hours_between(start, end) -> Column:
    """Fractional hours (PostgreSQL EXTRACT(EPOCH FROM b - a) / 3600)."""
    return (epoch_micros(end) - epoch_micros(start)) / F.lit(3.6e9)


def day_start(c) -> Column:
    """Midnight of the row's day as ``timestamp_ntz`` (DATE_TRUNC('day'))."""
    return F.to_date(col_of(c)).cast("timestamp_ntz")


def lit_ts(v) -> Column:
    """A literal timestamp_ntz from a datetime, date or ISO string."""
    if isinstance(v, Column):
        return ntz(v)
    if isinstance(v, str):
        v = datetime.fromisoformat(v)
    elif isinstance(v, date) and not isinstance(v, datetime):
        v = datetime(v.year, v.month, v.day)
    return F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")


def lit_date(v) -> Column:
    if isinstance(v, Column):
        return F.to_date(v)
    if isinstance(v, str):
        v = date.fromisoformat(v[:10])
    elif isinstance(v, datetime):
        v = v.date()
    return F.lit(v)
