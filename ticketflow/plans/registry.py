"""Registry of named queries: a Spark callable and (optionally) its DuckDB oracle."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketflow.plans.oracle import with_inputs


@dataclass
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str = ""


REGISTRY: dict[str, Query] = {}

# Fixed reporting dates for the registered queries (the library never reads the clock).
TICKETS_AS_OF = "1998-08-02 12:00:00"
LOGS_AS_OF = "2024-01-15 12:00:00"
SCALE = 6  # doubles are rounded to this many places on both sides of the oracle


def register(name: str, sql: str | None = None, inputs: tuple = ()):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, with_inputs(sql, *inputs) if sql else None,
                               (fn.__doc__ or "").strip())
        return fn
    return deco


def round_doubles(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """Round double/float columns for a stable comparison with the oracle."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), scale).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
