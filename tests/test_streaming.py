"""Streaming jobs: batch = stream equality and timer behaviour."""

import os
from datetime import datetime, timedelta

import pytest

from ticketflow.operators import lifecycle as L
from ticketflow.plans import stream_queries
from ticketflow.sources import adapters as A
from ticketflow.streaming import jobs, sinks

SMOKE = "/root/testdata/sf0.001"


def _dir(spark, name):
    return jobs.scratch(spark, name)


def test_intake_stream_equals_batch(spark):
    msgs = stream_queries._inbound_messages(spark, SMOKE)
    src = _dir(spark, "in")
    msgs.drop("_corrupt_record").write.json(src)
    out = _dir(spark, "out")
    jobs.intake_stream(spark, src, out)
    streamed = {tuple(r) for r in spark.read.parquet(out).drop("event_time").collect()}
    batch = {tuple(r) for r in jobs.intake_rows(msgs, dedupe_delay="batch").collect()}
    assert streamed == batch and len(streamed) > 0
    # redelivered events appear once
    ids = [r.event_id for r in spark.read.parquet(out).select("event_id").collect()]
    assert len(ids) == len(set(ids))


def test_kpi_stream_equals_batch(spark):
    from ticketflow.operators import kpi
    base = _dir(spark, "kpi")
    jobs.kpi_stream(spark, A.logs_of(A.events_stream(spark, SMOKE)), base)
    by_day = {r.window_start.date(): r for r in jobs.kpi_finish(sinks.read_current(spark, base)).collect()}
    daily = kpi.v_daily_kpi(A.logs(spark, SMOKE)).collect()
    assert len(by_day) == len(daily) > 0
    for d in daily:
        s = by_day[d.date]
        assert (s.total_inquiries, s.ai_responses, s.resolved, s.escalated) == \
               (d.total_inquiries, d.ai_responses, d.resolved, d.escalated)
        assert s.resolution_rate == d.resolution_rate
        assert abs((s.avg_tokens or 0) - (d.avg_tokens or 0)) < 1e-9


def _write_parts(spark, rows, schema, parts):
    base = _dir(spark, "parts")
    for i, chunk in enumerate(parts):
        spark.createDataFrame([rows[j] for j in chunk], schema).coalesce(1).write.parquet(f"{base}/p{i:03d}")
    return base


def test_open_tickets_stream_matches_batch(spark):
    t0 = datetime(2024, 1, 5, 9, 0, 0)
    rows = [("t1", "it", t0, 1), ("t1", "it", t0 + timedelta(seconds=5), 2), ("t2", "hr", t0, 3),
            ("t3", "it", t0, 4), ("t2", "hr", t0 + timedelta(minutes=1), 5), ("", "it", t0, 6)]
    schema = "thread_ts string, queue string, created_at timestamp_ntz, log_id long"
    src = _write_parts(spark, rows, schema, [[0, 2, 3], [1, 4, 5]])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    base = _dir(spark, "tickets")
    jobs.open_tickets_stream(spark, stream, base)
    got = sorted((r.log_id, r.ticket_id) for r in sinks.read_current(spark, base).collect())
    assert [x[0] for x in got] == [1, 3, 4, 6]
    ids = [x[1] for x in got]
    assert len(set(ids)) == len(ids)  # same-second tickets of later batches get a new suffix
    batch = sorted(r.log_id for r in L.open_tickets(spark.createDataFrame(rows, schema), None).collect())
    assert batch == [1, 3, 4, 6]


def test_feedback_stream_matches_batch(spark):
    t0 = datetime(2024, 1, 5, 9, 0, 0)
    logs = spark.createDataFrame([
        (1, "INQUIRY", "T", "OPEN", None), (2, "AI_RESPONSE", "T", "IN_PROGRESS", None),
        (3, "INQUIRY", "U", "OPEN", None), (4, "AI_RESPONSE", "U", "IN_PROGRESS", None),
    ], "id long, log_type string, thread_ts string, status string, resolved_at timestamp_ntz")
    base = _dir(spark, "logs")
    sinks.write_version(logs, base, -1)  # seed
    fb = [(2, "T", "resolved", t0, 10), (4, "U", "escalate", t0 + timedelta(minutes=1), 11),
          (4, "U", "resolved", t0 + timedelta(minutes=2), 12)]
    schema = "log_id long, thread_ts string, evaluation string, at timestamp_ntz, seq long"
    src = _write_parts(spark, fb, schema, [[0, 1], [2]])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    jobs.apply_feedback_stream(spark, stream, base)
    got = {r.id: r.status for r in sinks.read_current(spark, base).collect()}
    want = {r.id: r.status for r in L.apply_feedback_logs(logs, spark.createDataFrame(fb, schema)).collect()}
    assert got == want == {1: "RESOLVED", 2: "RESOLVED", 3: "RESOLVED", 4: "RESOLVED"}


def test_sla_timers_fire_once_past_the_watermark(spark):
    t0 = datetime(2024, 1, 5, 9, 0, 0)
    rows = [("A", "HIGH", "OPEN", t0, 1), ("B", "LOW", "OPEN", t0, 2), ("C", "HIGH", "OPEN", t0, 3),
            ("C", "HIGH", "RESOLVED", t0 + timedelta(minutes=30), 4), ("D", "HIGH", "OPEN", t0 + timedelta(hours=3), 5)]
    schema = "ticket_id string, urgency string, status string, at timestamp_ntz, seq long"
    src = _write_parts(spark, rows, schema, [[0, 1, 2], [3, 4]])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    base = _dir(spark, "sla")
    jobs.sla_breach_stream(spark, stream, base)
    got = sorted((r.ticket_id, r.kind) for r in jobs.sla_notices(spark, base).collect())
    # watermark ends at 3h - 10min: A passes warning (1.5h) and breach (2h); B (LOW) does not;
    # C was resolved before its timers; D opened at 3h.
    assert got == [("A", "breach"), ("A", "warning")]


def test_sla_breach_is_told_once(spark):
    t0 = datetime(2024, 1, 5, 9, 0, 0)
    rows = [("A", "HIGH", "OPEN", t0, 1), ("Z", "LOW", "OPEN", t0 + timedelta(hours=4), 2), ("A", "HIGH", "OPEN", t0 + timedelta(hours=5), 3),
            ("Z", "LOW", "OPEN", t0 + timedelta(hours=12), 4), ("Z", "LOW", "OPEN", t0 + timedelta(hours=13), 5)]
    schema = "ticket_id string, urgency string, status string, at timestamp_ntz, seq long"
    src = _write_parts(spark, rows, schema, [[0], [1], [2], [3], [4]])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    base = _dir(spark, "sla")
    jobs.sla_breach_stream(spark, stream, base)
    got = sorted((r.ticket_id, r.kind) for r in jobs.sla_notices(spark, base).collect())
    assert got == [("A", "breach"), ("A", "warning")]  # A's later open row does not arm it again


def test_intake_survives_bad_input(spark):
    src, out = _dir(spark, "bad-in"), _dir(spark, "bad-out")
    good = '{"event_id": "%d", "type": "message", "channel_type": "im", "message": "hi", "event_ts": "%s"}'
    lines = [good % (1, "1704067200"), good % (2, "soon"), "{broken", good % (3, "1704067300"), good % (4, "NaN")]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(src)
    jobs.intake_stream(spark, src, out)
    taken = sorted(r.event_id for r in spark.read.parquet(out).collect())
    rejected = sorted(r.reject_reason for r in spark.read.parquet(out + "_rejected").collect())
    assert taken == ["1", "3"] and rejected == ["bad event_ts", "bad event_ts", "corrupt JSON"]


def test_pointer_is_always_there(spark):
    base = _dir(spark, "ptr")
    for k in range(5):
        sinks.write_version(spark.createDataFrame([(k,)], "id long"), base, k)
        assert [r.id for r in sinks.read_current(spark, base).collect()] == [k]
    fs, _, jvm = sinks._fs(spark, base)
    names = {str(x.getPath().getName()) for x in fs.listStatus(jvm.org.apache.hadoop.fs.Path(base))}
    assert names == {"_CURRENT", "v000000000003", "v000000000004", "v000000000005"}  # older versions expire


def test_upsert_needs_an_order_for_repeated_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "id long, v string")
    with pytest.raises(ValueError):
        sinks.upsert_batch(df, 0, _dir(spark, "dup"), ["id"])


def test_versioned_sink_is_replay_safe(spark):
    base = _dir(spark, "v")
    df = spark.createDataFrame([(1, "a")], "id long, v string")
    sinks.upsert_batch(df, 0, base, ["id"])
    upd = spark.createDataFrame([(1, "b"), (2, "c")], "id long, v string")
    sinks.upsert_batch(upd, 1, base, ["id"])
    sinks.upsert_batch(upd, 1, base, ["id"])  # replayed batch
    assert sorted(tuple(r) for r in sinks.read_current(spark, base).collect()) == [(1, "b"), (2, "c")]
    assert os.path.basename(sinks.current_version(spark, base)) == "v000000000002"


def test_batch_sessions_match_brute_force_with_a_hot_user(spark):
    t0 = datetime(2024, 1, 5, 9, 0, 0)
    rows, i = [], 0
    for k in range(300):  # user U1 holds most rows; gaps of 10, 40 and exactly 30 minutes
        rows.append((i, "U1", t0 + timedelta(minutes=[10, 40, 30][k % 3] * k), "INQUIRY" if k % 2 else "AI_RESPONSE"))
        i += 1
    for k in range(20):
        rows.append((i, f"U{k % 4 + 2}", t0 + timedelta(minutes=7 * k), "INQUIRY"))
        i += 1
    rows.append((i, "U2", t0 + timedelta(minutes=7), "INQUIRY"))  # equal timestamps
    df = spark.createDataFrame(rows, "id long, user_id string, created_at timestamp_ntz, log_type string")
    got = sorted(tuple(r) for r in jobs.conversation_sessions(df, "30 minutes").collect())
    want = []
    by_user = {}
    for r in sorted(rows, key=lambda x: (x[1], x[2], x[0])):
        by_user.setdefault(r[1], []).append(r)
    for u, evs in by_user.items():
        cur = None
        for _, _, ts, lt in evs:
            if cur is None or ts >= cur["last"] + timedelta(minutes=30):
                if cur:
                    want.append((u, cur["start"], cur["last"] + timedelta(minutes=30), cur["n"], cur["q"]))
                cur = {"start": ts, "last": ts, "n": 0, "q": 0}
            cur["last"], cur["n"], cur["q"] = ts, cur["n"] + 1, cur["q"] + (lt == "INQUIRY")
        want.append((u, cur["start"], cur["last"] + timedelta(minutes=30), cur["n"], cur["q"]))
    assert got == sorted(want)
