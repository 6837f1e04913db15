"""Searches, near copies, names and learned categories at their limits: each in bounded pieces, the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from ticketflow.operators import entities, near
from ticketflow.operators import search as K
from ticketflow.session import small_batches
from ticketflow.streaming import jobs
from ticketflow.streaming.text_index import TextIndex


def _rows(df):
    return sorted((r.query_id, r.rank, r.doc_id, round(r.score, 8)) for r in df.collect())


def _corpus(spark, rng, n=300):
    words = ["common"] * 8 + [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(k, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for k in range(n)] + [(n, None), (n + 1, ""), (3, "common w1 common")],
                                 "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(f"q{k}", "common " + " ".join(rng.choices(words, k=2))) for k in range(50)] + [("none", "zzz")], "query_id string, text string")
    return docs, queries


@pytest.mark.parametrize("ngram", [0, 2])
@pytest.mark.parametrize("bound", ["TRIPLES", "CELLS", "MAX_BROADCAST_TERMS"])
def test_search_in_bounded_pieces(spark, monkeypatch, ngram, bound):
    docs, queries = _corpus(spark, random.Random(1))
    whole = _rows(K.bm25_topk(queries, docs, ngram=ngram))
    assert len(whole) >= 250
    monkeypatch.setattr(K, bound, 7)
    assert _rows(K.bm25_topk(queries, docs, ngram=ngram)) == whole


def test_documents_reach_python_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    docs, queries = _corpus(spark, random.Random(2), 20)
    K.bm25_topk(queries, docs).collect()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == K.BATCH
    small_batches(spark, 5_000)  # a smaller bound stays
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == K.BATCH


@pytest.mark.parametrize("met_at_most", [0, 100, 3_000, 10**9])
def test_short_queries_share_their_common_terms(spark, met_at_most):
    docs, queries = _corpus(spark, random.Random(3))
    assert _rows(K.bm25_topk_short(queries, docs, met_at_most=met_at_most)) == _rows(K.bm25_topk(queries, docs))
    assert _rows(K.bm25_topk_short(queries.limit(0), docs)) == [] and _rows(K.bm25_topk_short(queries, docs.limit(0))) == []


def test_index_stores_a_document_once(spark):
    """A row per document and one per term; a batch leaves no scratch tables."""
    docs, queries = _corpus(spark, random.Random(4))
    docs = docs.dropDuplicates(["doc_id"])
    index = TextIndex(spark, jobs.scratch(spark, "ix"), buckets=4)
    index.update(docs, 0)
    index.update(docs.where("doc_id % 3 = 0").withColumn("text", F.lit("common again")), 1)
    assert index.terms.read().count() == docs.count() and not hasattr(index, "postings")
    now = docs.where("text is not null").withColumn("text", F.when(F.col("doc_id") % 3 == 0, "common again").otherwise(F.col("text")))
    now = now.unionByName(docs.where("text is null and doc_id % 3 = 0").withColumn("text", F.lit("common again")))
    assert _rows(index.topk(queries)) == _rows(K.bm25_topk(queries, now))


def test_buckets_of_the_same_classes_are_compared_once(spark):
    rows = [(band, key, c, 3) for band in range(30) for key in (1, 2) for c in (10 * key, 10 * key + 1, 10 * key + 2)]
    buckets = spark.createDataFrame(rows, "band int, key long, class_id long, n long")
    assert sorted(r.members for r in near._sets(buckets).collect()) == [[10, 11, 12], [20, 21, 22]]


def test_learned_rows_are_those_of_the_least_hash(spark):
    ids = spark.range(5_000).select(F.col("id").cast("string").alias("id"))
    ids = ids.union(ids.limit(50)).select(F.xxhash64("id").alias("h"), "id")
    want = ids.distinct().orderBy("h", "id").limit(700).collect()[-1]
    assert entities._last_of_least(ids, 700) == want
    assert entities._last_of_least(ids, 5_000) is None
    skewed = ids.withColumn("h", F.lit(1 << 62))  # the bound on the hash leaves none
    assert entities._last_of_least(skewed, 700)["id"] == sorted(str(k) for k in range(5_000))[699]


def test_people_and_places_in_one_pass(spark):
    people = spark.createDataFrame([(1, "Ann Lee", "IT", "Osaka"), (2, "Bob", "HR", "Kyoto"), (3, "Osaka", "IT", None)],
                                   "employee_id int, employee_name string, department string, location string")
    messages = spark.createDataFrame([(1, "ann lee in kyoto"), (2, "HR: bob!"), (3, "osaka"), (4, None), (5, "it")], "id int, text string")
    found = entities.extract_people_and_places(messages, people, "id", "text")
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "Ann Lee", "IT", "Kyoto"), (2, "Bob", "HR", "Kyoto"), (3, "Osaka", "IT", "Osaka"),
                                                            (4, None, None, None), (5, None, "IT", None)]
    # the messages are cut into n-grams once, not per dictionary
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate inline") == 1
