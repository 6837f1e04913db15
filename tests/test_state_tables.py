"""Merge-on-read state tables, kept aggregates, numbers over batches, sessions, timers, text index."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ticketflow.operators import kpi, lifecycle as L, search as K
from ticketflow.streaming import jobs, sinks, upkeep
from ticketflow.streaming.state_table import StateTable
from ticketflow.streaming.text_index import TextIndex

T0 = datetime(2024, 1, 5, 9, 0, 0)


def _dir(spark, name):
    return jobs.scratch(spark, name)


def _bytes(spark, path):
    fs, p, _ = sinks._fs(spark, path)
    return fs.getContentSummary(p).getLength()


def test_state_table_against_a_dict(spark):
    rng = random.Random(1)
    base, want = _dir(spark, "st"), {}
    schema = "k long, g string, v string, at long"
    for batch_id in range(8):
        rows = [(rng.choice([None, *range(40)]), rng.choice(["a", "b", None]), f"{batch_id}-{j}", rng.randint(0, 5) + batch_id // 2) for j in range(30)]
        df = spark.createDataFrame(rows, schema)
        table = StateTable(spark, base, ["k", "g"], "at", buckets=4)
        batch = {}
        for r in table.newest(df).collect():
            batch[r.k, r.g] = tuple(r)
        for key in {(r[0], r[1]) for r in rows}:
            assert batch[key][3] == max(r[3] for r in rows if (r[0], r[1]) == key)
        for key, row in batch.items():
            if key not in want or row[3] >= want[key][3]:
                want[key] = row
        assert table.upsert(df, batch_id)
        assert table.upsert(df, batch_id) is None  # a replay
        assert sorted(map(tuple, sinks.read_current(spark, base).collect()), key=str) == sorted(want.values(), key=str)
        some = spark.createDataFrame([(3, "a"), (None, None), (99, "a")], "k long, g string")
        assert sorted(map(tuple, table.read_keys(some).collect()), key=str) == sorted((want[k] for k in [(3, "a"), (None, None)] if k in want), key=str)


def test_a_batch_writes_its_own_rows(spark):
    """One key of a hundred changes: about a hundredth of the table is written."""
    base = _dir(spark, "small")
    rows = spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"))
    StateTable(spark, base, ["id"]).upsert(rows, -1)
    whole = _bytes(spark, base)
    for n in range(3):
        StateTable(spark, base, ["id"]).upsert(rows.where(f"id % 100 = {n}").withColumn("v", F.reverse("v")), n)
        assert _bytes(spark, f"{base}/v{n + 1:012d}") < 0.03 * whole
    got = sinks.read_current(spark, base)
    assert got.count() == 200_000
    assert got.join(rows.withColumnRenamed("v", "w"), "id").where("v = w").count() == 194_000


def test_only_full_buckets_are_rewritten_and_old_files_go(spark):
    base = _dir(spark, "compact")
    rows = spark.range(1_000).select("id", F.lit(0).alias("v"))
    table = StateTable(spark, base, ["id"], buckets=8)
    table.upsert(rows, -1)
    one = rows.where(table.bucket() == 3)
    for n in range(6):  # every batch changes half of one bucket
        table.upsert(one.limit(60).withColumn("v", F.lit(n + 1)), n)
        assert table.read().where(f"v = {n + 1}").count() == min(60, one.count())
    m = table._manifest()
    assert {b for b, f in m["base"].items() if f != "v000000000000/base"} == {"3"}
    fs, root, _ = sinks._fs(spark, base)
    kept = {str(x.getPath().getName()) for x in fs.listStatus(root)} - {"_CURRENT"}
    assert len(kept) <= 5 and "v000000000000" in kept  # the first version still holds the other buckets


def test_a_replay_before_publishing_rewrites_the_same(spark, monkeypatch):
    base = _dir(spark, "crash")
    df = spark.createDataFrame([(k, "a") for k in range(20)], "id long, v string")
    table = StateTable(spark, base, ["id"])
    table.upsert(df, 0)
    change = df.where("id < 5").withColumn("v", F.lit("b"))
    with monkeypatch.context() as m:
        def lost(*a):
            raise RuntimeError("executor lost")
        m.setattr(sinks, "publish", lost)
        with pytest.raises(RuntimeError):
            table.upsert(change, 1)
    assert table.read().where("v = 'b'").count() == 0  # nothing half-written is read
    table.upsert(change, 1)
    assert table.read().where("v = 'b'").count() == 5 and table.read().count() == 20


def test_a_whole_table_is_taken_into_buckets(spark):
    base = _dir(spark, "adopt")
    sinks.write_version(spark.createDataFrame([(1, "a"), (2, "a")], "id long, v string"), base, -1)
    StateTable(spark, base, ["id"]).upsert(spark.createDataFrame([(2, "b"), (3, "b")], "id long, v string"), 0)
    assert sorted(map(tuple, sinks.read_current(spark, base).collect())) == [(1, "a"), (2, "b"), (3, "b")]


# ---------------------------------------------------------------- kept aggregates

TICKETS = "ticket_id string, created_at timestamp_ntz, category string, priority string, status string, resolved_at timestamp_ntz, updated_at long"


def _ticket(rng, k, at):
    made = T0 + timedelta(hours=k % 60)
    status = rng.choice(["OPEN", "RESOLVED", "CLOSED", None])
    return (f"T{k}", made, rng.choice(["HARDWARE", None]), rng.choice(["HIGH", "LOW"]), status, made + timedelta(minutes=rng.randint(0, 500)) if status == "RESOLVED" else None, at)


def test_daily_stats_equal_a_recompute_after_every_batch(spark):
    rng = random.Random(2)
    tickets, days, want = _dir(spark, "t"), _dir(spark, "d"), {}
    for batch_id in range(4):
        rows = [_ticket(rng, k, batch_id if rng.random() < 0.8 else -1) for k in rng.sample(range(40), 25)]
        df = spark.createDataFrame(rows, TICKETS)
        for r in rows:
            if r[0] not in want or r[6] >= want[r[0]][6]:
                want[r[0]] = r
        upkeep.keep_daily_stats(df, batch_id, tickets, days)
        upkeep.keep_daily_stats(df, batch_id, tickets, days)
        now = kpi.ticket_stats_daily(spark.createDataFrame(list(want.values()), TICKETS))
        key = lambda r: str(tuple(r))
        assert sorted(map(tuple, upkeep.daily_stats(spark, days).collect()), key=str) == sorted(map(tuple, now.collect()), key=str), key


def test_a_crash_between_the_two_tables_counts_nothing_twice(spark, monkeypatch):
    tickets, days = _dir(spark, "t"), _dir(spark, "d")
    one = spark.createDataFrame([("A", T0, "X", "LOW", "OPEN", None, 0)], TICKETS)
    two = spark.createDataFrame([("A", T0, "X", "LOW", "CLOSED", None, 1), ("B", T0, "X", "LOW", "OPEN", None, 1)], TICKETS)
    upkeep.keep_daily_stats(one, 0, tickets, days)
    real = StateTable.upsert
    with monkeypatch.context() as m:
        def lost(self, *a, **kw):
            if self.base == tickets:
                raise RuntimeError("executor lost")
            return real(self, *a, **kw)
        m.setattr(StateTable, "upsert", lost)
        with pytest.raises(RuntimeError):
            upkeep.keep_daily_stats(two, 1, tickets, days)
    upkeep.keep_daily_stats(two, 1, tickets, days)
    (r,) = upkeep.daily_stats(spark, days).collect()
    assert (r.ticket_count, r.open_count, r.resolved_count) == (2, 1, 0)
    assert sinks.read_current(spark, tickets).count() == 2


def test_ticket_numbers_go_on_over_batches(spark):
    base = _dir(spark, "ids")
    req = [spark.createDataFrame([(10 * b + k, T0 + timedelta(seconds=k), "C1") for k in range(3)], "request_id long, created_at timestamp_ntz, source_channel string")
           for b in range(2)]
    for batch_id, df in ((0, req[0]), (0, req[0]), (1, req[1])):
        upkeep.create_tickets_batch(df, batch_id, base)
    ids = sorted(r.ticket_id for r in sinks.read_current(spark, base).collect())
    assert ids == [f"TKT-20240105-{k:05d}" for k in range(1, 7)]
    assert sorted(r.ticket_id for r in upkeep.created_actions(spark, base).collect()) == ids


# ---------------------------------------------------------------- sessions and timers

LOGS = "id long, user_id string, created_at timestamp_ntz, log_type string"


def _stream(spark, chunks, schema):
    base = _dir(spark, "src")
    for i, rows in enumerate(chunks):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/p{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base + "/*")


def test_sessions_closed_and_open_equal_the_batch_form(spark):
    rng = random.Random(3)
    rows, t = [], 0
    for k in range(400):  # a third of the events are one user's; events come up to 50 minutes late
        t += rng.choice([1, 5, 40])
        late = rng.randint(0, 50)
        rows.append((k, "HOT" if k % 3 == 0 else rng.choice(["A", "B", None]), T0 + timedelta(minutes=t - late), rng.choice(["INQUIRY", "AI_RESPONSE"])))
    rows.append((900, "A", None, "INQUIRY"))
    base = _dir(spark, "sessions")
    jobs.session_stream(spark, _stream(spark, [rows[k:k + 100] for k in range(0, 401, 100)], LOGS), base, delay="2 hours")
    closed, open_ = jobs.closed_sessions(spark, base).collect(), jobs.open_sessions(spark, base).collect()
    want = jobs.conversation_sessions(spark.createDataFrame(rows, LOGS)).collect()
    cols = ("user_id", "session_start", "session_end", "events", "inquiries")
    as_rows = lambda rs: sorted((tuple(r[c] for c in cols) for r in rs), key=str)
    assert as_rows([*closed, *open_]) == as_rows(want)
    assert closed and open_
    newest = max(r[2] for r in rows if r[2])
    assert all(r.session_end <= newest - timedelta(hours=2) for r in closed) and all(r.session_end > newest - timedelta(hours=2) for r in open_)


def test_events_behind_the_mark_are_left_out(spark):
    chunks = [[(1, "A", T0, "INQUIRY"), (2, "B", T0 + timedelta(hours=5), "INQUIRY")], [(3, "A", T0 + timedelta(minutes=1), "INQUIRY"), (4, "A", T0 + timedelta(hours=6), "INQUIRY")]]
    base = _dir(spark, "late")
    jobs.session_stream(spark, _stream(spark, chunks, LOGS), base, delay="1 hour")
    got = sorted((r.user_id, r.events) for r in [*jobs.closed_sessions(spark, base).collect(), *jobs.open_sessions(spark, base).collect()])
    assert got == [("A", 1), ("A", 1), ("B", 1)]


EVENTS = "ticket_id string, urgency string, status string, at timestamp_ntz, seq long"


def _notices(spark, chunks, **kw):
    base = _dir(spark, "sla")
    jobs.sla_breach_stream(spark, _stream(spark, chunks, EVENTS), base, **kw)
    return sorted((r.ticket_id, r.kind) for r in jobs.sla_notices(spark, base).collect())


def test_a_ticket_with_a_third_of_the_events(spark):
    hot = [("HOT", "HIGH", "OPEN" if k % 2 else "RESOLVED", T0 + timedelta(seconds=k), k) for k in range(1000)]  # ends open
    rest = [(f"T{k % 50}", "HIGH", "OPEN", T0 + timedelta(seconds=k), k) for k in range(2000)]
    end = [("END", "LOW", "OPEN", T0 + timedelta(hours=4), 9999)]
    got = _notices(spark, [hot + rest + end])
    assert got == sorted((t, kind) for t in ["HOT", *(f"T{k}" for k in range(50))] for kind in ("warning", "breach"))


def test_timers_over_batches(spark):
    h = lambda n: T0 + timedelta(hours=n)
    chunks = [[("A", "HIGH", "OPEN", T0, 1), ("B", "HIGH", "OPEN", T0, 2), ("C", "HIGH", "OPEN", T0, 3)],
              [("B", "HIGH", "RESOLVED", h(1), 4), ("Z", "LOW", "OPEN", h(1.75), 5)],                       # mark 1h35: A and C are warned
              [("C", "HIGH", "CLOSED", h(1.8), 6), ("C", "HIGH", "OPEN", h(1.9), 7), ("Z", "LOW", "OPEN", h(3), 8)],  # 2h50: A is breached; C starts anew
              [("A", "HIGH", "OPEN", h(3.5), 9), ("A", None, "RESOLVED", h(3.6), 10), ("A", "MEDIUM", "OPEN", h(3.7), 11), ("Z", "LOW", "OPEN", h(4.2), 12)],  # 4h02: C again
              [(None, "HIGH", "OPEN", T0, 13), ("N", "HIGH", "OPEN", None, 14), ("Y", "LOW", "OPEN", h(10.5), 15)]]  # 10h20: A's second warning
    assert _notices(spark, chunks) == [("A", "breach"), ("A", "warning"), ("A", "warning"), ("C", "breach"), ("C", "warning"), ("C", "warning")]


def test_a_breach_is_forgotten_after_the_time_given(spark):
    chunks = [[("A", "HIGH", "OPEN", T0, 1)], [("Z", "LOW", "RESOLVED", T0 + timedelta(days=3), 2)], [("A", "HIGH", "OPEN", T0 + timedelta(days=3), 3)],
              [("Z", "LOW", "RESOLVED", T0 + timedelta(days=4), 4)]]
    assert _notices(spark, chunks) == [("A", "breach"), ("A", "warning")]
    assert _notices(spark, chunks, done_kept="1 day") == [("A", "breach")] * 2 + [("A", "warning")] * 2


# ---------------------------------------------------------------- text index

def test_index_equals_a_rebuild_after_every_batch(spark):
    rng = random.Random(5)
    words = ["vpn", "printer", "login", "slow", "画面", "password", "the", "a"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
    queries = spark.createDataFrame([(1, "vpn slow"), (2, "the printer"), (3, "zzz"), (4, ""), (5, "画面")], "query_id long, text string")
    for ngram in (0, 2):
        index, now = TextIndex(spark, _dir(spark, "ix"), ngram=ngram, buckets=4), {}
        for batch_id in range(4):
            rows = [(k, rng.choice([text(), text(), None])) for k in rng.sample(range(40), 25)]
            now.update(rows)
            df = spark.createDataFrame(rows, "doc_id long, text string")
            index.update(df, batch_id)
            index.update(df, batch_id)
            live = spark.createDataFrame([(k, t) for k, t in now.items() if t is not None], "doc_id long, text string")
            got = sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in index.topk(queries).collect())
            want = sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in K.bm25_topk(queries, live, ngram=ngram).collect())
            assert got == want and got
