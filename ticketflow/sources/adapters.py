"""Reference-shaped inputs derived from the driver tables.

The driver tables are a TPC-H-like star schema plus ``events``, ``documents``,
``conversations`` and ``embeddings``. These adapters only rename and map
columns into the schemas the jobs expect (FIXTURES.md section 1); they do
none of the jobs' work. ``plans/oracle.py`` repeats each mapping as a DuckDB
CTE so a query and its oracle read identical inputs.

Joins here are left to Catalyst: ``nation``/``region`` are fixed 25/5-row
dimensions and fall under the broadcast threshold by their file statistics;
``customer`` and the per-order ``lineitem`` aggregate are shuffled on their
keys once they grow past it.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


_SCHEMAS: dict = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet read; the schema of a path is discovered once per application.

    The files are listed anew by every read, so a table that was rewritten is
    read as it is now.
    """
    path = os.path.join(sf_dir, f"{name}.parquet")
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def _padded(number: Column, digits: int) -> Column:
    """The number with leading zeros up to ``digits``; a longer one is never cut."""
    s = number.cast("string")
    return F.lpad(s, F.greatest(F.lit(digits), F.length(s)), F.lit("0"))


def _case(c: Column, mapping: dict, default=None) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out


# Segment -> ticket id prefix / queue / issue type.
SEGMENT_PREFIX = {"MACHINERY": "IT-", "BUILDING": "HR-", "FURNITURE": "FIN-"}
SEGMENT_QUEUE = {"MACHINERY": "it", "BUILDING": "hr", "FURNITURE": "finance"}
SEGMENT_ISSUE = {"MACHINERY": "HARDWARE", "AUTOMOBILE": "SOFTWARE", "BUILDING": "ACCOUNT",
                 "FURNITURE": "EXPENSE", "HOUSEHOLD": "OTHER"}


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """helpdesk_tickets (+ snapshot aliases category/priority/department)."""
    o = read(spark, sf_dir, "orders")
    c = read(spark, sf_dir, "customer")
    n = read(spark, sf_dir, "nation")
    r = read(spark, sf_dir, "region")
    last_ship = (read(spark, sf_dir, "lineitem").groupBy("l_orderkey")
                 .agg(F.max("l_shipdate").alias("last_ship")))
    geo = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    base = (o.join(c, o.o_custkey == c.c_custkey)
            .join(geo, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .join(last_ship, o.o_orderkey == last_ship.l_orderkey, "left"))
    k = F.col("o_orderkey")
    st = F.col("o_orderstatus")
    status = (F.when(st == "F", F.when(k % 5 == 0, "CLOSED").otherwise("RESOLVED"))
              .when(st == "O", F.when(k % 7 == 0, "ESCALATED")
                    .when(k % 11 == 0, "HUMAN_REQUESTED").otherwise("OPEN"))
              .otherwise("IN_PROGRESS"))
    p1 = F.substring("o_orderpriority", 1, 1)
    urgency = F.when(p1.isin("1", "2"), "HIGH").when(p1 == "3", "MEDIUM").otherwise("LOW")
    resolved = F.when((st == "F") & (F.col("last_ship") >= F.col("o_orderdate")), F.col("last_ship"))
    seg = F.col("c_mktsegment")
    issue = _case(seg, SEGMENT_ISSUE, "OTHER")
    return base.select(
        F.concat(_case(seg, SEGMENT_PREFIX, "GEN-"), k.cast("string")).alias("ticket_id"),
        F.col("c_name").alias("reporter_name"),
        F.col("o_custkey").cast("string").alias("reporter_employee_id"),
        F.col("r_name").alias("location"),
        F.col("n_name").alias("department"),
        issue.alias("issue_type"),
        issue.alias("category"),
        urgency.alias("urgency"),
        urgency.alias("priority"),
        F.concat(F.lower(seg), F.lit(" request from "), F.col("c_name")).alias("summary"),
        k.alias("log_id"),
        F.concat(F.col("o_custkey").cast("string"), F.lit("-"),
                 F.date_format("o_orderdate", "yyyyMMdd")).alias("thread_ts"),
        F.when(k % 4 == 0, "slack").when(k % 4 == 1, "web")
         .when(k % 4 == 2, F.concat(F.lit("C"), (F.col("o_custkey") % 10).cast("string")))
         .alias("source_channel"),
        _case(seg, SEGMENT_QUEUE, "general").alias("queue"),
        status.alias("status"),
        F.when(k % 3 != 0, F.concat(F.lit("agent"), (F.col("o_custkey") % 9).cast("string")))
         .alias("assigned_to"),
        F.col("o_orderdate").alias("created_at"),
        F.coalesce(resolved, F.col("o_orderdate")).alias("updated_at"),
        resolved.alias("resolved_at"),
    )


# Event type -> log type / evaluation / status.
EVENT_LOG_TYPE = {"view": "INQUIRY", "click": "AI_RESPONSE", "purchase": "EVALUATION",
                  "error": "EVALUATION", "signup": "INFO_RECEIVED"}
EVENT_EVALUATION = {"purchase": "resolved", "error": "escalate"}
EVENT_STATUS = {"purchase": "RESOLVED", "error": "ESCALATED"}
USER_CATEGORY = {0: "it", 1: "hr", 2: "finance", 3: "other"}


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """helpdesk_logs from ``events``: thread = user + day; signups have no thread."""
    return logs_of(read(spark, sf_dir, "events"))


def events_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """The ``events`` table as a file stream (directory source, file glob)."""
    r = spark.readStream.schema(read(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(sf_dir)


def logs_of(e: DataFrame) -> DataFrame:
    """The log mapping applied to any events frame (batch or streaming)."""
    et = F.col("event_type")
    return e.select(
        F.col("event_id").alias("id"),
        _case(et, EVENT_LOG_TYPE, "INFO_RECEIVED").alias("log_type"),
        F.when(et.isin("click", "purchase", "error"), F.col("event_id") - 1).alias("inquiry_id"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_id"),
        F.concat(F.lit("C"), (F.col("user_id") % 10).cast("string")).alias("channel_id"),
        F.when(et != "signup", F.concat(F.col("user_id").cast("string"), F.lit("-"),
                                        F.date_format("ts", "yyyyMMdd"))).alias("thread_ts"),
        F.concat(et, F.lit(" "), F.col("props")).alias("message"),
        _case(F.col("user_id") % 4, USER_CATEGORY).alias("category"),
        F.when(F.col("value") >= 40, "HIGH").when(F.col("value") >= 15, "MEDIUM")
         .otherwise("LOW").alias("priority"),
        F.when(et == "click", F.concat(F.lit("answer "), F.col("props"))).alias("ai_response_text"),
        F.get_json_object("props", "$.k").cast("int").alias("tokens_input"),
        F.floor("value").cast("int").alias("tokens_output"),
        _case(et, EVENT_EVALUATION).alias("evaluation"),
        _case(et, EVENT_STATUS, "OPEN").alias("status"),
        F.col("ts").alias("created_at"),
        F.when(et == "purchase", F.col("ts")).alias("resolved_at"),
    )


def conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows from ``conversations``: one thread per conv_id, one minute per turn."""
    cv = read(spark, sf_dir, "conversations")
    role = F.col("role")
    return cv.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("thread_ts"),
        F.concat(F.lit("U"), F.col("conv_id").cast("string")).alias("user_id"),
        F.when(role == "user", "INQUIRY").when(role == "assistant", "AI_RESPONSE")
         .otherwise("INFO_RECEIVED").alias("log_type"),
        F.when(role != "assistant", F.col("text")).alias("message"),
        F.when(role == "assistant", F.col("text")).alias("ai_response_text"),
        F.lit("OPEN").alias("status"),
        F.expr("timestampadd(MINUTE, conv_id * 60 + turn, timestamp_ntz'2024-01-01 00:00:00')")
         .alias("created_at"),
    )


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """knowledge_articles from ``documents`` + ``labels``; exact copies share a title."""
    d = read(spark, sf_dir, "documents")
    lb = read(spark, sf_dir, "labels")
    return d.join(lb, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("title"),
        F.col("text").alias("content"),
        F.col("lang").alias("category"),
        F.col("source").alias("subcategory"),
        F.concat(F.col("lang"), F.lit(", "), F.col("source"), F.lit(" ,")).alias("tags"),
        F.lit(0).alias("views"),
        F.col("source").alias("author"),
        F.col("quality").alias("helpful"),
        F.col("toxic").alias("not_helpful"),
        F.expr("timestampadd(MINUTE, doc_id, timestamp_ntz'2024-01-01 00:00:00')").alias("created_at"),
    )


def article_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View events per article: ``view`` events name an article in props.k."""
    e = read(spark, sf_dir, "events")
    return e.where(F.col("event_type") == "view").select(
        F.get_json_object("props", "$.k").cast("long").alias("article_id"),
        F.col("ts").alias("viewed_at"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """assets from ``part``: location by region, assignee names match customer names."""
    p = read(spark, sf_dir, "part")
    r = read(spark, sf_dir, "region")
    k = F.col("p_partkey")
    return p.join(r, (F.col("p_size") % 5) == F.col("r_regionkey"), "left").select(
        k.alias("id"),
        F.concat(F.lit("AST-"), _padded(k, 6)).alias("asset_id"),
        F.col("p_type").alias("asset_type"),
        F.col("p_name").alias("name"),
        F.when(k % 4 != 0, F.concat(F.lit("Customer#"),
                                    _padded(k % 97, 9))).alias("assignee"),
        F.col("r_name").alias("location"),
        F.when(F.col("p_size") % 10 == 0, "MAINTENANCE").when(F.col("p_size") % 10 == 1, "RETIRED")
         .otherwise("ACTIVE").alias("status"),
        F.col("p_brand").alias("notes"),
    )


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    n = read(spark, sf_dir, "nation")
    r = read(spark, sf_dir, "region")
    geo = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    return c.join(geo, c.c_nationkey == geo.n_nationkey, "left").select(
        F.concat(F.lit("E"), F.col("c_custkey").cast("string")).alias("employee_id"),
        F.col("c_name").alias("employee_name"),
        F.col("n_name").alias("department"),
        F.col("r_name").alias("location"),
    )


def ticket_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successive saved versions of a ticket: one per event of a user."""
    e = read(spark, sf_dir, "events")
    et = F.col("event_type")
    return e.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticket_id"),
        F.col("event_id").alias("version_id"),
        F.col("ts").alias("changed_at"),
        _case(et, {"view": "OPEN", "click": "IN_PROGRESS", "purchase": "RESOLVED",
                   "error": "ESCALATED", "signup": "OPEN"}).alias("status"),
        F.concat(F.lit("agent"), (F.floor("value") % 3).cast("string")).alias("assigned_to"),
        F.when(et == "purchase", F.lit("done")).alias("resolution_notes"),
        F.concat(F.lit("agent"), (F.col("event_id") % 5).cast("string")).alias("author"),
    )
