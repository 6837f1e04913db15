"""Table sources and sinks (S1-S3, S6-S8, S11, S12) and the reference seed rows.

Writes are idempotent by construction: a sink either overwrites a
versioned directory (readers switch by a pointer file written last) or
appends rows whose key is checked with an anti join first, so a retried
task or a replayed batch does not duplicate rows.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketflow import schemas


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str = "parquet") -> DataFrame:
    """Full-row table read with an explicit schema (no inference)."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str,
              lower: int, upper: int, num_partitions: int, properties: dict | None = None) -> DataFrame:
    """S1 against a live database: range-partitioned parallel reads.

    Needs the JDBC driver jar on the classpath (not present here; untested).
    """
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower,
                           upperBound=upper, numPartitions=num_partitions,
                           properties=properties or {})


def read_snapshot(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a columnar snapshot (the current version when one is published)."""
    from ticketflow.streaming.sinks import current_version
    return spark.read.format(fmt).load(current_version(spark, path) or path)


# The snapshot column lists of the reference export.
TICKET_SNAPSHOT_COLUMNS = ["ticket_id", "employee_id", "employee_name", "department", "category",
                           "priority", "status", "subject", "description", "resolution",
                           "created_at", "updated_at", "resolved_at"]
ASSET_SNAPSHOT_COLUMNS = ["asset_id", "asset_name", "asset_type", "assigned_to", "department",
                          "status", "location"]


def ticket_snapshot(tickets: DataFrame) -> DataFrame:
    """Project helpdesk_tickets onto the 13 snapshot columns."""
    return tickets.select(
        "ticket_id", F.col("reporter_employee_id").alias("employee_id"),
        F.col("reporter_name").alias("employee_name"),
        F.col("department") if "department" in tickets.columns else F.lit(None).cast("string").alias("department"),
        F.col("issue_type").alias("category"), F.col("urgency").alias("priority"), "status",
        F.col("summary").alias("subject"), F.col("summary").alias("description"),
        (F.col("resolution_notes") if "resolution_notes" in tickets.columns
         else F.lit(None).cast("string")).alias("resolution"),
        "created_at", "updated_at", "resolved_at")


def export_snapshot(df: DataFrame, path: str, version: str, columns: list[str] | None = None,
                    partition_by: list[str] | None = None, fmt: str = "parquet") -> str:
    """S3: full refresh into ``path/<version>``; the pointer is switched last.

    Overwrite of a live directory is not atomic, so readers only ever see
    a completely written version.
    """
    out = path.rstrip("/") + "/" + version
    w = (df.select(*columns) if columns else df).write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(out)
    from ticketflow.streaming.sinks import publish  # pointer via the Hadoop FileSystem API
    publish(df.sparkSession, path, version)
    return out


def replace_table(df: DataFrame, path: str, version: str, fmt: str = "parquet") -> str:
    """Delete all, reload: a new version under a switched pointer, so a
    reader sees the old table or the new one."""
    return export_snapshot(df, path, version, fmt=fmt)


def new_rows(batch: DataFrame, target: DataFrame | None, key: list[str], order: list[str]) -> DataFrame:
    """S7 core: rows of ``batch`` whose key is absent from ``target``; one per key.

    ``INSERT ... ON CONFLICT DO NOTHING`` keeps the first of several rows
    with the same key in a batch: the least by ``order``.
    """
    first = F.min_by(F.struct(*batch.columns), F.struct(*order)).alias("_r")
    b = batch.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(first).select("_r.*")
    if target is None:
        return b
    return b.join(target.select(*key).distinct(), key, "left_anti")


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, asked of the Hadoop file system it lies in."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def insert_ignore(batch: DataFrame, target_path: str, key: list[str], order: list[str], fmt: str = "parquet") -> None:
    """Append rows whose key does not exist yet. A target that cannot be
    read is an error; only a missing one counts as empty."""
    spark = batch.sparkSession
    target = spark.read.format(fmt).load(target_path) if table_exists(spark, target_path) else None
    new_rows(batch, target, key, order).write.mode("append").format(fmt).save(target_path)


def split_valid(batch: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split a batch into (valid, rejected) by required fields.

    A field counts as missing when null or '' (the reference's ``!x`` test).
    The rejected frame carries a ``reject_reason`` naming the first missing
    field, so nothing is dropped silently.
    """
    missing = [F.col(c).isNull() | (F.col(c).cast("string") == "") for c in required]
    any_missing = reduce(lambda a, b: a | b, missing) if missing else F.lit(False)
    reason = None
    for c, m in zip(required, missing):
        reason = F.when(m, F.lit(f"missing {c}")) if reason is None else reason.when(m, F.lit(f"missing {c}"))
    return batch.where(~any_missing), batch.where(any_missing).withColumn("reject_reason", reason)


def with_defaults(batch: DataFrame, defaults: dict) -> DataFrame:
    """JS ``x || default``: null, '' (and 0 for numbers) take the default."""
    out = batch
    for c, v in defaults.items():
        col = F.col(c)
        blank = col.isNull() | ((col == F.lit(0)) if isinstance(v, (int, float)) and not isinstance(v, bool)
                                else (col.cast("string") == ""))
        out = out.withColumn(c, F.when(blank, F.lit(v)).otherwise(col))
    return out


def create_records(batch: DataFrame, required: list[str], defaults: dict,
                   now) -> tuple[DataFrame, DataFrame]:
    """Validated insert with defaults and created/updated stamps."""
    from ticketflow.functions.timeutil import lit_ts
    valid, rejected = split_valid(batch, required)
    valid = with_defaults(valid, defaults)
    for c in ("created_at", "updated_at"):
        valid = valid.withColumn(c, lit_ts(now)) if c not in valid.columns else \
            valid.withColumn(c, F.coalesce(F.col(c), lit_ts(now)))
    return valid, rejected


def delete_records(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Delete by id = anti join against the delete-key frame."""
    return table.join(keys.select(key).distinct(), key, "left_anti")


# The reference seed rows of system_settings and service_catalog.
SEED_SETTINGS = [
    (1, "sla_high", "2", "number", "HIGH緊急度のSLA時間"),
    (2, "sla_medium", "8", "number", "MEDIUM緊急度のSLA時間"),
    (3, "sla_low", "24", "number", "LOW緊急度のSLA時間"),
    (4, "auto_escalate", "true", "boolean", "SLA超過時の自動エスカレーション"),
    (5, "notify_new_ticket", "true", "boolean", "新規チケット通知"),
    (6, "notify_assign", "true", "boolean", "アサイン通知"),
    (7, "notify_sla_warning", "true", "boolean", "SLA警告通知"),
    (8, "notify_sla_breach", "true", "boolean", "SLA超過通知"),
]
SEED_CATALOG = [
    (1, "PC申請", "新規PC・交換の申請", "HARDWARE", "Laptop", 72),
    (2, "アカウント作成", "新規システムアカウントの発行", "ACCOUNT", "Key", 24),
    (3, "VPN設定", "リモートアクセス設定の申請", "SOFTWARE", "Wifi", 48),
    (4, "その他問い合わせ", "上記以外の問い合わせ", "OTHER", "HelpCircle", 120),
]


def seed_settings(spark: SparkSession) -> DataFrame:
    rows = [(i, k, v, t, dsc, datetime(2024, 1, 1)) for i, k, v, t, dsc in SEED_SETTINGS]
    return spark.createDataFrame(rows, schemas.SYSTEM_SETTINGS)


def seed_catalog(spark: SparkSession) -> DataFrame:
    rows = [(i, t, dsc, c, ic, h, True, datetime(2024, 1, 1)) for i, t, dsc, c, ic, h in SEED_CATALOG]
    return spark.createDataFrame(rows, schemas.SERVICE_CATALOG)
