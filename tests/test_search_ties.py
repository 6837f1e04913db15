"""Top-k under ties, id types and blocks; ids that never collide."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ticketflow.operators import lifecycle as L
from ticketflow.operators import search as K


@pytest.mark.parametrize("parts", [1, 7])
def test_ties_go_to_the_smallest_ids(spark, parts):
    v = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(60)] + [(60, [0.0, 0.0])], "vec_id long, embedding array<float>").repartition(parts)
    q = spark.createDataFrame([(9, [2.0, 4.0])], "query_id long, embedding array<float>")
    got = [(r["rank"], r.vec_id) for r in K.similar_vectors(q, v, k=5).orderBy("rank").collect()]
    assert got == [(k + 1, k) for k in range(5)]
    d = spark.createDataFrame([(i, "printer is broken") for i in range(60)], "doc_id long, text string").repartition(parts)
    qs = spark.createDataFrame([(1, "broken printer")], "query_id long, text string")
    got = [(r["rank"], r.doc_id) for r in K.bm25_topk(qs, d, k=5).orderBy("rank").collect()]
    assert got == [(k + 1, k) for k in range(5)]


def test_text_ids_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(K, "QUERY_BLOCK", 2)
    monkeypatch.setattr(K, "CORPUS_BLOCK", 7)
    rows = [(f"T-{i:03d}", [float(i % 9), 1.0]) for i in range(80)]
    v = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    q = v.where(F.col("vec_id") < "T-009").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in K.similar_vectors(q, v, k=3, exclude_self=True).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    for i in range(9):  # the same vector comes back every 9 rows
        assert [got[f"T-{i:03d}"][k] for k in (1, 2, 3)] == [f"T-{i + 9 * k:03d}" for k in (1, 2, 3)]
    d = spark.createDataFrame([(f"D{i}", "vpn down" if i % 2 else "mail slow") for i in range(10)], "doc_id string, text string")
    qs = spark.createDataFrame([("q1", "vpn"), ("q2", "slow mail"), ("q3", "none of it")], "query_id string, text string")
    for pairs in (1, 1000):  # one (query, term) pair a chunk, and all at once
        res = sorted((r.query_id, r["rank"], r.doc_id) for r in K.bm25_topk(qs, d, k=2, max_pairs=pairs).collect())
        assert res == [("q1", 1, "D1"), ("q1", 2, "D3"), ("q2", 1, "D0"), ("q2", 2, "D2")]
    grams = K.bm25_topk(spark.createDataFrame([(1, "アカウント")], "query_id long, text string"),
                        spark.createDataFrame([(1, "アカウントがロック"), (2, "プリンター")], "doc_id long, text string"), ngram=2)
    assert [(r.doc_id, r["rank"]) for r in grams.collect()] == [(1, 1)]


def test_ordinals_are_never_cut(spark):
    t = spark.range(100_050).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("ticket_id"),
                                    F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("created_at"))
    out = L.ticket_ordinal(t)
    assert out.select("ordinal_id").distinct().count() == 100_050
    assert out.agg(F.max(F.length("ordinal_id"))).first()[0] == len("TKT-20240101-100050")


def test_older_change_does_not_replace_a_newer_row(spark):
    cur = spark.createDataFrame([(1, "new", 10), (2, "old", 1)], "id long, v string, updated_at long")
    ch = spark.createDataFrame([(1, "stale", 5), (2, "fresh", 5), (3, "added", 1), (2, "tie", 5)], "id long, v string, updated_at long").where("v <> 'tie'")
    assert sorted((r.id, r.v) for r in K.upsert_corpus(cur, ch).collect()) == [(1, "new"), (2, "fresh"), (3, "added")]


def test_triage_keywords_are_whole_words(spark):
    from ticketflow.functions import text
    rows = [("please download it",), ("I am happy",), ("upcoming PC swap",), ("VPN is down",), ("パソコンが故障",)]
    got = [(r.urgency, r.category) for r in spark.createDataFrame(rows, "m string").select(*text.triage("m")).collect()]
    assert got == [("LOW", "OTHER"), ("LOW", "OTHER"), ("LOW", "HARDWARE"), ("HIGH", "SOFTWARE"), ("LOW", "HARDWARE")]
