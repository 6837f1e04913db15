"""Edge rows for SLA, threads, dedupe, patches, feedback folds and ids."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ticketflow.functions import sla
from ticketflow.functions.skew import sequence_within
from ticketflow.operators import lifecycle as L
from ticketflow.operators import listing as S
from ticketflow.operators import threads as T

NOW = datetime(2024, 1, 10, 12, 0, 0)


def test_sla_state_boundaries(spark):
    rows = [
        ("a", "HIGH", "OPEN", NOW - timedelta(hours=2)),                 # remaining exactly 0 -> normal
        ("b", "HIGH", "OPEN", NOW - timedelta(minutes=90)),              # exactly 25% left -> normal
        ("c", "HIGH", "OPEN", NOW - timedelta(minutes=91)),              # under 25% -> warning
        ("d", "LOW", "OPEN", NOW - timedelta(hours=24, minutes=30)),     # 30 min late -> 1h30m quirk
        ("e", "WEIRD", "OPEN", NOW - timedelta(hours=1)),                # unknown urgency -> 8h
        ("f", "HIGH", "CLOSED", NOW - timedelta(days=3)),                # done
    ]
    df = spark.createDataFrame(rows, "ticket_id string, urgency string, status string, created_at timestamp_ntz")
    r = {x.ticket_id: x for x in sla.sla_state(df, NOW).collect()}
    assert r["a"].sla_state == "normal" and r["a"].remaining_ms == 0
    assert r["b"].sla_state == "normal"
    assert r["c"].sla_state == "warning"
    assert r["d"].sla_state == "overdue" and r["d"].sla_text == "SLA超過 1h30m" and r["d"].overdue_minutes == 30
    assert r["d"].progress_pct == 100.0
    assert r["e"].sla_hours == 8 and r["e"].sla_text == "残り 7h0m"
    assert r["f"].sla_state == "done" and r["f"].sla_text == "完了" and r["f"].remaining_ms is None


def _logs(spark, rows):
    return spark.createDataFrame(rows, "id long, log_type string, thread_ts string, message string, "
                                       "evaluation string, status string, created_at timestamp_ntz")


def test_thread_summary_edges(spark):
    t0 = NOW
    rows = [
        (1, "INQUIRY", None, "lonely", None, "OPEN", t0),
        (2, "INQUIRY", "", "empty thread", None, "OPEN", t0),
        (3, "AI_RESPONSE", "T1", "first row", None, "IN_PROGRESS", t0),        # thread without INQUIRY
        (4, "EVALUATION", "T1", None, "escalate", "OPEN", t0 + timedelta(minutes=1)),
        (5, "INQUIRY", "T2", "", None, "OPEN", t0),                            # empty inquiry message
        (6, "AI_RESPONSE", "T2", "resp", None, "RESOLVED", t0),                # equal created_at: id breaks tie
    ]
    s = {r.thread_key: r for r in T.thread_summary(_logs(spark, rows)).collect()}
    assert set(s) == {"no-thread-1", "no-thread-2", "T1", "T2"}
    assert s["T1"].first_message == "first row" and s["T1"].evaluation_result == "escalate"
    assert s["T1"].status == "OPEN" and s["T1"].has_evaluation and s["T1"].log_count == 2
    assert s["T2"].first_message == "-" or s["T2"].first_message == ""  # '' inquiry -> first row '' -> '-'
    assert s["T2"].first_message == "-" and s["T2"].status == "RESOLVED"
    st = T.thread_stats(T.thread_summary(_logs(spark, rows))).collect()[0]
    assert (st.threads, st.resolved, st.escalated, st.pending) == (4, 0, 1, 3)
    assert sum(r.log_count for r in s.values()) == len(rows)


def test_dedupe_keeps_min_id_and_null_keys_group(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (5, None), (4, None), (2, "y")], "id long, title string")
    kept = sorted(r.id for r in L.dedupe_keep_first(df, "title").collect())
    assert kept == [1, 2, 4]
    again = sorted(r.id for r in L.dedupe_keep_first(L.dedupe_keep_first(df, "title"), "title").collect())
    assert again == kept
    assert sorted(r.id for r in L.duplicates_to_delete(df, "title").collect()) == [3, 5]


def test_patch_null_keeps_empty_overwrites(spark):
    cur = spark.createDataFrame([("A", "OPEN", "bob", "note", NOW, None)],
                                "ticket_id string, status string, assigned_to string, resolution_notes string, "
                                "updated_at timestamp_ntz, resolved_at timestamp_ntz")
    patches = spark.createDataFrame([("A", None, "", None, 1), ("A", "RESOLVED", None, None, 2)],
                                    "ticket_id string, status string, assigned_to string, "
                                    "resolution_notes string, seq int")
    out = L.patch_columns(cur, patches, "ticket_id", ["status", "assigned_to", "resolution_notes"],
                          datetime(2024, 2, 1), "seq").collect()[0]
    assert (out.status, out.assigned_to, out.resolution_notes) == ("RESOLVED", "", "note")
    assert out.resolved_at == datetime(2024, 2, 1) and out.updated_at == datetime(2024, 2, 1)
    none = L.patch_columns(cur, patches.limit(0), "ticket_id", ["status"], datetime(2024, 2, 1), "seq").collect()[0]
    assert (none.status, none.updated_at) == ("OPEN", NOW)


def test_feedback_twice_and_out_of_order(spark):
    logs = _logs(spark, [
        (1, "INQUIRY", "T", "q", None, "OPEN", NOW),
        (2, "AI_RESPONSE", "T", "a", None, "IN_PROGRESS", NOW),
        (3, "INQUIRY", "T", "q2", None, "ESCALATED", NOW),
        (4, "AI_RESPONSE", "U", "a", None, "OPEN", NOW),
    ]).withColumn("resolved_at", F.lit(None).cast("timestamp_ntz"))
    # arrives out of order: the escalate (later) is listed first; resolved twice
    fb = spark.createDataFrame([
        (2, "T", "escalate", NOW + timedelta(minutes=5), 11),
        (2, "T", "resolved", NOW + timedelta(minutes=1), 10),
        (2, "T", "resolved", NOW + timedelta(minutes=1), 10),
        (4, "U", "direct_ticket", NOW, 12),
    ], "log_id long, thread_ts string, evaluation string, at timestamp_ntz, seq long")
    r = {x.id: x for x in L.apply_feedback_logs(logs, fb).collect()}
    assert r[2].status == "ESCALATED" and r[2].resolved_at == NOW + timedelta(minutes=1)
    assert r[1].status == "RESOLVED" and r[3].status == "ESCALATED"
    assert r[4].status == "HUMAN_REQUESTED"
    tickets = spark.createDataFrame([("IT-1", "OPEN", "HIGH", None), ("IT-2", "OPEN", "HIGH", None)],
                                    "ticket_id string, status string, urgency string, resolved_at timestamp_ntz")
    tf = fb.withColumn("ticket_id", F.when(F.col("log_id") == 2, "IT-1").otherwise("IT-2"))
    t = {x.ticket_id: x for x in L.apply_feedback_tickets(tickets, tf).collect()}
    assert t["IT-1"].status == "ESCALATED" and t["IT-1"].urgency == "HIGH"
    assert t["IT-2"].status == "HUMAN_REQUESTED" and t["IT-2"].urgency == "LOW"


def test_two_tickets_in_one_second_get_distinct_ids(spark):
    c = spark.createDataFrame([
        ("t1", "it", NOW, 1), ("t2", "it", NOW, 2), ("", "hr", NOW, 3), (None, "hr", NOW, 4), ("t1", "it", NOW, 5),
    ], "thread_ts string, queue string, created_at timestamp_ntz, log_id long")
    out = sorted((r.log_id, r.ticket_id) for r in L.open_tickets(c, None).collect())
    assert out == [(1, "IT-20240110-120000"), (2, "IT-20240110-120000-2"),
                   (3, "HR-20240110-120000"), (4, "HR-20240110-120000-2")]
    existing = spark.createDataFrame([("IT-X", "t2")], "ticket_id string, thread_ts string")
    again = sorted(r.log_id for r in L.open_tickets(c, existing).collect())
    assert again == [1, 3, 4]


def test_sequence_within_matches_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 5003).alias("o"),
                                     F.col("id"))
    # one key holds two thirds of the rows
    df = df.withColumn("k", F.when(F.col("k") == 2, F.lit(0)).otherwise(F.col("k")))
    got = {(r.id, r.rn) for r in sequence_within(df, ["k"], ["o", "id"], "rn", partitions=7).collect()}
    from pyspark.sql import Window
    w = Window.partitionBy("k").orderBy("o", "id")
    want = {(r.id, r.rn) for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert got == want
    glob = {(r.id, r.rn) for r in sequence_within(df, [], ["o", "id"], "rn", partitions=5).collect()}
    assert glob == {(r.id, r.rn) for r in df.withColumn("rn", F.row_number().over(Window.orderBy("o", "id"))).collect()}


def test_change_log_null_safe(spark):
    v = spark.createDataFrame([
        ("A", 1, NOW, "OPEN", None, None, "x"),
        ("A", 2, NOW, "OPEN", "bob", None, None),
        ("A", 3, NOW, "RESOLVED", "bob", "", "y"),
        ("A", 4, NOW, "RESOLVED", "bob", None, "y"),
    ], "ticket_id string, version_id long, changed_at timestamp_ntz, status string, assigned_to string, "
       "resolution_notes string, author string")
    got = sorted((r.version_id, r.field, r.old_value, r.new_value, r.author) for r in L.change_log(v).collect())
    assert got == [(2, "assigned_to", None, "bob", "システム"), (3, "resolution_notes", None, "", "y"),
                   (3, "status", "OPEN", "RESOLVED", "y"), (4, "resolution_notes", "", None, "y")]
    txt = sorted((r.version_id, r.old_value, r.new_value) for r in L.change_log(v, null_text=True).collect()
                 if r.field == "resolution_notes")
    assert txt == [(3, "null", "null"), (4, "null", "null")]


def test_search_keeps_wildcards_unless_escaped(spark):
    df = spark.createDataFrame([("a%b",), ("axb",), ("a_b",), ("a\\b",)], "t string")
    assert sorted(r.t for r in S.search_any(df, "a%b", ["t"]).collect()) == ["a%b", "a\\b", "a_b", "axb"]
    assert [r.t for r in S.search_any(df, "a%b", ["t"], escape=True).collect()] == ["a%b"]
    assert [r.t for r in S.search_any(df, "A_B", ["t"], escape=True).collect()] == ["a_b"]
    assert [r.t for r in S.search_any(df, "a\\b", ["t"], escape=True).collect()] == ["a\\b"]
