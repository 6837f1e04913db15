"""Operators stay exact when one key holds a third (or more) of all rows."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ticketflow.operators import lifecycle as L
from ticketflow.operators import search as K
from ticketflow.operators import threads as T

T0 = datetime(2024, 1, 1)


def _logs(n=3000):
    rows = []
    for i in range(n):
        thread = "HOT" if i % 3 == 0 else (None if i % 17 == 0 else f"T{i % 97}")
        lt = ["INQUIRY", "AI_RESPONSE", "EVALUATION"][i % 3 if i % 5 else 0]
        rows.append((i, lt, thread, f"m{i}", "resolved" if lt == "EVALUATION" else None,
                     ["OPEN", "RESOLVED"][i % 2], T0 + timedelta(seconds=(i * 7919) % 5000)))
    return rows


SCHEMA = ("id long, log_type string, thread_ts string, message string, evaluation string, status string, "
          "created_at timestamp_ntz")


def test_thread_summary_with_hot_thread(spark):
    rows = _logs()
    got = {r.thread_key: r for r in T.thread_summary(spark.createDataFrame(rows, SCHEMA)).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[2] if r[2] else f"no-thread-{r[0]}", []).append(r)
    assert set(got) == set(groups)
    for k, g in groups.items():
        g = sorted(g, key=lambda r: (r[6], r[0]))
        inq = next((r for r in g if r[1] == "INQUIRY"), None)
        first = (inq[3] if inq and inq[3] else None) or g[0][3] or "-"
        ev = next((r for r in g if r[1] == "EVALUATION"), None)
        s = got[k]
        assert (s.first_message, s.log_count, s.status, s.has_evaluation) == (first, len(g), g[-1][5], ev is not None)
        assert s.created_at == g[0][6]


def test_dedupe_with_hot_title(spark):
    rows = [(i, "same" if i % 3 == 0 else f"t{i % 50}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, title string")
    kept = sorted(r.id for r in L.dedupe_keep_first(df, "title").collect())
    want = sorted({t: min(i for i, tt in rows if tt == t) for _, t in rows}.values())
    assert kept == want


def test_duplicate_groups_with_hot_group(spark):
    rows = [(i, "Same  text\n" if i % 3 == 0 else f"text {i % 40}") for i in range(1500)]
    got = {r.doc_id: (r.group_id, r.group_size) for r in
           K.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    norm = {i: " ".join(t.lower().split()) for i, t in rows}
    for i, t in norm.items():
        members = [j for j, u in norm.items() if u == t]
        assert got[i] == (min(members), len(members))


def test_ticket_conversation_hot_thread(spark):
    logs = spark.createDataFrame(_logs(), SCHEMA).withColumn("ai_response_text", F.lit(None).cast("string"))
    tickets = spark.createDataFrame([("IT-1", "HOT"), ("IT-2", "T5"), ("IT-3", ""), ("IT-4", None)],
                                    "ticket_id string, thread_ts string")
    got = T.ticket_conversation(tickets, logs).groupBy("ticket_id").agg(F.count("log_id").alias("n")).collect()
    assert {r.ticket_id: r.n for r in got} == {"IT-1": 1000, "IT-2": sum(1 for i in range(3000) if i % 3 and i % 17 and i % 97 == 5),
                                               "IT-3": 0, "IT-4": 0}


def test_joins_of_a_hot_key_are_split(spark):
    """A third of the rows on one key: adaptive execution splits the join (``skew=true``)."""
    low = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
           "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.autoBroadcastJoinThreshold": "-1",
           "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in low}
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        hot = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), (F.col("id") % 5000).cast("string")))
        logs = spark.range(60_000).select(
            "id", hot.alias("thread_ts"), F.lit("INQUIRY").alias("log_type"), F.col("id").cast("string").alias("message"),
            F.lit("OPEN").alias("status"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("created_at"),
            F.lit(None).cast("timestamp_ntz").alias("resolved_at"))
        fb = logs.where("id % 2 = 0").select(F.col("id").alias("log_id"), "thread_ts", F.lit("resolved").alias("evaluation"),
                                             F.col("created_at").alias("at"), F.col("id").alias("seq"))
        frames = {"first_last": T.first_last_in_thread(logs), "feedback": L.apply_feedback_logs(logs, fb),
                  "near_duplicates": K.near_duplicate_groups(logs, "id", "thread_ts")}
        tickets = logs.select(F.col("id").cast("string").alias("ticket_id"), F.col("thread_ts").alias("reporter_name"), F.lit("here").alias("location"))
        owners = logs.select(F.col("thread_ts").alias("assignee"), F.lit("here").alias("location"), F.concat(F.lit("A"), "thread_ts").alias("asset_id"),
                             F.lit("PC").alias("asset_type"), F.lit("ACTIVE").alias("status")).distinct()
        frames["match_asset"] = K.match_asset(tickets, owners)
        for name, df in frames.items():
            assert len(df.collect()) == 60_000, name
            assert "skew=true" in df._jdf.queryExecution().executedPlan().toString(), name
        # children of a parent: the join that comes before their numbering
        kids = logs.select(F.col("thread_ts").alias("ticket_id"), "id", "message")
        joined = kids.join(logs.select(F.col("thread_ts").alias("ticket_id")), "ticket_id", "left_semi")
        assert joined.count() == T.children_of(logs.select(F.col("thread_ts").alias("ticket_id")), kids, "ticket_id", ["id"]).count() == 60_000
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
