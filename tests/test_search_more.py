"""Hashed vector search, many search terms, asset fallback, names and learned categories, kept caps."""

import random

import numpy as np
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.sql import functions as F

from ticketflow.operators import entities, listing, lsh, search as K
from ticketflow.sources import adapters as A

SF = "/root/testdata/sf0.01"


def _frame(spark, x):
    return spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(3)


def _clustered(rng, n, spread=0.15):
    centres = rng.normal(size=(60, 32))
    return centres[rng.integers(0, 60, n)] + spread * rng.normal(size=(n, 32))


def _recall(found, exact, k):
    want: dict = {}
    for r in exact:
        want.setdefault(r.query_id, {})[r.vec_id] = r.similarity
    least = {q: min(v.values()) for q, v in want.items()}
    return sum(r.similarity >= least[r.query_id] for r in found) / (k * len(want))


def test_hashed_search_finds_near_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(1)
    c = _frame(spark, _clustered(rng, 6000))
    q = c.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    used = []
    real = lsh.choose
    monkeypatch.setattr(lsh, "choose", lambda *a, **kw: used.append(real(*a, **kw)) or used[-1])
    found = lsh.similar_vectors(q, c, exclude_self=True).collect()
    assert used[0] is not None  # hashes were used, not the exact search
    exact = K.similar_vectors(q, c, exclude_self=True).collect()
    assert _recall(found, exact, 5) >= 0.9
    scores = {(r.query_id, r.vec_id): r.similarity for r in exact}
    assert all(abs(scores.get((r.query_id, r.vec_id), r.similarity) - r.similarity) < 1e-9 for r in found)
    assert sorted((r.query_id, r["rank"]) for r in found) == sorted((r.query_id, r["rank"]) for r in exact)


def test_hashed_search_of_a_third_alike(spark, monkeypatch):
    """A bucket with a third of the vectors meets block by block."""
    monkeypatch.setattr(lsh, "BLOCK", 300)
    rng = np.random.default_rng(2)
    x = _clustered(rng, 3000)
    x[:1000] = x[0] + 1e-3 * rng.normal(size=(1000, 32))
    c = _frame(spark, x)
    q = c.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    found, exact = (f(q, c, exclude_self=True).collect() for f in (lsh.similar_vectors, K.similar_vectors))
    assert _recall(found, exact, 5) >= 0.9 and len(found) == len(exact)


def test_queries_with_too_few_candidates_are_answered_exactly(spark, monkeypatch):
    c = _frame(spark, np.random.default_rng(3).normal(size=(400, 16)))
    q = c.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    narrow = BucketedRandomProjectionLSH(inputCol="u", outputCol="hashes", bucketLength=0.02, numHashTables=4, seed=1).fit(lsh._directions(c, "vec_id", "embedding"))
    monkeypatch.setattr(lsh, "choose", lambda *a, **kw: (narrow, 2, 2))
    found, exact = (sorted(map(tuple, f(q, c, exclude_self=True).collect())) for f in (lsh.similar_vectors, K.similar_vectors))
    assert found == exact and len(found) == 40


def test_vectors_without_near_neighbours_are_searched_exactly(spark):
    c = A.vectors(spark, SF)
    rows = lsh._directions(c, "vec_id", "embedding")
    assert lsh.choose(rows, 5, 0.95) is None
    assert lsh.similar_vectors(c.limit(0).withColumnRenamed("vec_id", "query_id"), c).count() == 0


def test_many_terms_equal_one_search_each(spark):
    rng = random.Random(1)
    rows = [(k, "".join(rng.choice("aBc %_é\\") for _ in range(rng.randint(0, 12))), rng.choice([None, "abc", "x"])) for k in range(200)]
    rows += [(900, None, None), (901, "", ""), (902, "ab" * 500, "x")]
    df = spark.createDataFrame(rows, "id long, text string, gram string").repartition(3)
    terms = ["abc", "ABC", "a", "ab", "%b", "a_c", "c é", "zzz", "", None, "bcab", "B%c", "é", "x", "babab"]
    asked = spark.createDataFrame(list(enumerate(terms)), "term_id int, term string")
    got: dict = {}
    for r in listing.search_many(df, asked, ["text", "gram"], "id", scan_at_once=3).collect():
        assert r.id not in got.setdefault(r.term_id, set())
        got[r.term_id].add(r.id)
    for k, t in enumerate(terms):
        want = {r.id for r in listing.search_any(df, t, ["text", "gram"]).collect()} if t else set()
        assert got.get(k, set()) == want, t


def test_every_ticket_that_shares_a_term_gets_assets(spark):
    assets = spark.createDataFrame([("A1", "PC", "ACTIVE", "Ann", "Tokyo", "pc of Ann in Tokyo"), ("A2", "PC", "ACTIVE", "Bob", "Osaka", "scanner Osaka Bob"),
                                    ("A3", "PC", "RETIRED", "Ann", "Kyoto", "pc Kyoto"), ("A4", "PC", "ACTIVE", None, "Kyoto", "spare printer Kyoto")],
                                   "asset_id string, asset_type string, status string, assignee string, location string, asset_text string")
    tickets = spark.createDataFrame([("T1", "Ann", "Tokyo"), ("T2", "Ann", "Kyoto"), ("T3", "Zoe", "Osaka"), ("T4", "Zoe", "Paris"), ("T5", None, "Tokyo"), ("T6", "Ann", "Kyoto")],
                                    "ticket_id string, reporter_name string, location string")
    got: dict = {}
    for r in K.find_asset(tickets, assets, F.concat_ws(" ", "reporter_name", "location")).collect():
        got.setdefault(r.ticket_id, []).append((r.found_by, r.asset_rank, r.asset_id))
    assert got["T1"] == [("owner", 1, "A1")]
    assert sorted(got["T2"]) == sorted(got["T6"]) and {a for _, _, a in got["T2"]} == {"A1", "A4"}
    assert got["T3"] == [("text", 1, "A2")] and got["T5"] == [("text", 1, "A1")] and "T4" not in got


def test_names_longest_match_wins(spark):
    names = spark.createDataFrame([("New York",), ("York",), ("new-york city",), ("Ann Lee",), ("Ann",), (None,), ("!!",)], "name string")
    messages = spark.createDataFrame([(1, "in New York City, not York"), (2, "YORK or new york"), (3, "ann"), (4, "Yorkshire annex"), (5, None), (6, ""), (7, "Ann; Lee")],
                                     "id long, text string")
    got = {r.id: r.name for r in entities.find_names(messages, names, "id", "text").collect()}
    assert got == {1: "new-york city", 2: "New York", 3: "Ann", 4: None, 5: None, 6: None, 7: "Ann Lee"}


def test_learned_category_on_held_out_rows(spark):
    from ticketflow.plans.registry import REGISTRY
    rows = REGISTRY["triage_learned"].run(spark, SF).where("held_out").collect()
    assert len(rows) > 150
    assert sum(r.predicted == r.category for r in rows) / len(rows) >= 0.9


def test_ids_are_never_cut(spark):
    df = spark.createDataFrame([(7,), (123456,), (1234560,), (1234567,)], "k long")
    assert [r[0] for r in df.select(A._padded(F.col("k"), 6)).collect()] == ["000007", "123456", "1234560", "1234567"]
