"""Table sources and sinks (S1-S3, S7, S8, S11, S12) and the incremental export."""

from datetime import datetime

from pyspark.sql import functions as F

from ticketflow import schemas
from ticketflow.sources import tables as TB
from ticketflow.streaming import jobs, sinks


def test_split_valid_and_defaults(spark):
    rows = [("A-1", "PC", "ok", None), ("", "PC", "missing id", "MAINTENANCE"), ("A-3", None, "no type", None)]
    df = spark.createDataFrame(rows, "asset_id string, asset_type string, name string, status string")
    valid, rejected = TB.create_records(df, ["asset_id", "asset_type"], {"status": "ACTIVE"}, datetime(2024, 1, 1))
    v = valid.collect()
    assert [(r.asset_id, r.status) for r in v] == [("A-1", "ACTIVE")]
    assert v[0].created_at == datetime(2024, 1, 1)
    assert sorted((r.name, r.reject_reason) for r in rejected.collect()) == [
        ("missing id", "missing asset_id"), ("no type", "missing asset_type")]
    cat = TB.with_defaults(spark.createDataFrame([(0,), (None,), (48,)], "sla_hours int"), {"sla_hours": 24})
    assert [r.sla_hours for r in cat.collect()] == [24, 24, 48]


def test_insert_ignore_and_delete(spark):
    path = jobs.scratch(spark, "assets")
    a = spark.createDataFrame([("A", 1), ("B", 2), ("A", 3)], "asset_id string, v int")
    TB.insert_ignore(a, path, ["asset_id"], ["v"])
    TB.insert_ignore(spark.createDataFrame([("B", 9), ("C", 4)], "asset_id string, v int"), path, ["asset_id"], ["v"])
    got = spark.read.parquet(path)
    assert sorted((r.asset_id, r.v) for r in got.collect()) == [("A", 1), ("B", 2), ("C", 4)]  # the first of a key stays
    left = TB.delete_records(got, spark.createDataFrame([("B",)], "asset_id string"), "asset_id")
    assert sorted(r.asset_id for r in left.collect()) == ["A", "C"]


def test_export_snapshot_pointer(spark):
    base = jobs.scratch(spark, "snap")
    t = spark.createDataFrame([("IT-1", "E1", "n", "d", "HARDWARE", "HIGH", "OPEN", "s", None,
                                datetime(2024, 1, 1), datetime(2024, 1, 1), None)],
                              "ticket_id string, reporter_employee_id string, reporter_name string, department string, "
                              "issue_type string, urgency string, status string, summary string, "
                              "resolution_notes string, created_at timestamp_ntz, updated_at timestamp_ntz, "
                              "resolved_at timestamp_ntz")
    snap = TB.ticket_snapshot(t)
    assert snap.columns == TB.TICKET_SNAPSHOT_COLUMNS
    TB.export_snapshot(snap, base, "v1")
    TB.export_snapshot(snap.withColumn("status", F.lit("CLOSED")), base, "v2")
    assert TB.read_snapshot(spark, base).collect()[0].status == "CLOSED"


def test_export_incremental_upserts(spark):
    src = jobs.scratch(spark, "exp-src")
    base = jobs.scratch(spark, "exp")
    schema = "ticket_id string, status string, updated_at timestamp_ntz"
    spark.createDataFrame([("A", "OPEN", datetime(2024, 1, 1)), ("B", "OPEN", datetime(2024, 1, 1))],
                          schema).write.parquet(src + "/p1")
    stream = lambda: spark.readStream.schema(schema).parquet(src + "/*")
    jobs.export_incremental(spark, stream(), base, ["ticket_id"])
    spark.createDataFrame([("A", "RESOLVED", datetime(2024, 1, 2)), ("A", "CLOSED", datetime(2024, 1, 3)),
                           ("B", "STALE", datetime(2023, 12, 1)), ("C", "OPEN", datetime(2024, 1, 1))],
                          schema).write.parquet(src + "/p2")
    jobs.export_incremental(spark, stream(), base, ["ticket_id"])  # next scheduled run
    got = sorted((r.ticket_id, r.status) for r in sinks.read_current(spark, base).collect())
    assert got == [("A", "CLOSED"), ("B", "OPEN"), ("C", "OPEN")]  # the late older row of B does not win


def test_read_events_keeps_corrupt_lines(spark):
    src = jobs.scratch(spark, "ev")
    spark.createDataFrame([('{"event_id": "1", "type": "message", "channel_type": "im", "message": "hi", '
                            '"event_ts": "1704067200"}',), ("{broken",)], "value string").write.text(src)
    rows = jobs.read_events(spark, src)
    out = jobs.scratch(spark, "ev-out")
    jobs.run(rows.writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", jobs.scratch(spark, "ev-ck")))
    got = spark.read.schema(schemas.INBOUND_MESSAGE).parquet(out).collect()
    assert len(got) == 2 and sum(1 for r in got if r._corrupt_record is not None) == 1


def test_replace_table_overwrites(spark):
    path = jobs.scratch(spark, "faq")
    TB.replace_table(spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string"), path, "v1")
    TB.replace_table(spark.createDataFrame([(3, "c")], "id long, t string"), path, "v2")
    assert [tuple(r) for r in TB.read_snapshot(spark, path).collect()] == [(3, "c")]
