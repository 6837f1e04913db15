"""K1 / J10 past the cross product: vector search by random projection hashing.

Directions are hashed by Spark ML's ``BucketedRandomProjectionLSH``; several
hashes make a key and several keys a table each, so near directions share a
bucket of some table. A query meets the vectors of its buckets only, each scored
exactly. The hashes are chosen on a sample: the cheapest choice that finds the
asked recall there. Where no choice does at a share of the corpus that pays (the
vectors have no near neighbours), and for queries with too few candidates, the
exact search answers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketflow.operators import search
from ticketflow.session import cut_lineage, ship_package

SAMPLE = 2_000                  # vectors that the hashes are chosen on, through the driver
WIDTHS = (0.5, 1.0, 2.0, 4.0)   # bucket lengths, in distances to the k-th neighbour
KEYS = ((8, 6), (4, 6), (8, 12), (4, 12), (2, 12), (4, 24))  # (hashes of a key, tables), by growing cost
SHARE = 0.25                    # of the corpus as candidates, beyond which hashing saves nothing
BLOCK = 4_096                   # vectors, or queries, of a bucket that meet at once


def _directions(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v, u): vectors that are neither null nor zero, and their unit vectors."""
    rows = df.select(F.col(id_col).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.withColumn("n", norm).where(F.col("n") > 0).select("id", "v", array_to_vector(F.transform("v", lambda x: x / F.col("n"))).alias("u"))


def _hashes(m: int, tables: int) -> Column:
    """array<struct<t, key>> from the model's hashes."""
    flat = F.transform("hashes", lambda h: F.get(vector_to_array(h), F.lit(0)).cast("long"))
    return F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.struct(t.alias("t"), F.xxhash64(F.slice(flat, t * m + 1, m)).alias("key")))


def choose(corpus: DataFrame, k: int, recall: float, seed: int = 42):
    """(model, hashes of a key, tables), or None where none finds the recall.

    In a sample the neighbours are farther away than in the whole corpus, so the
    recall found there is a lower one.
    """
    sample = cut_lineage(corpus.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).select("id", "u"))
    x = np.array([r["u"].toArray() for r in sample.orderBy("id").collect()])
    if len(x) <= 10 * k:
        return None
    asked = np.arange(0, len(x), max(1, len(x) // 200))
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-s, axis=1, kind="stable")[:, :k]
    kth = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(s, near[:, -1:], axis=1), 0))
    length = max(float(np.median(kth)), 1e-6)
    most = max(m * tables for m, tables in KEYS)
    models, hashed = {}, {}
    for w in WIDTHS:
        models[w] = BucketedRandomProjectionLSH(inputCol="u", outputCol="hashes", bucketLength=w * length, numHashTables=most, seed=seed).fit(sample)
        flat = F.transform("hashes", lambda h: F.get(vector_to_array(h), F.lit(0)))
        hashed[w] = np.array([r["h"] for r in models[w].transform(sample).orderBy("id").select(flat.alias("h")).collect()])
    for m, tables in KEYS:
        for w in WIDTHS:
            h = hashed[w][:, :m * tables].reshape(len(x), tables, m)
            hit = np.zeros((len(asked), len(x)), dtype=bool)
            for t in range(tables):
                hit |= (h[asked][:, None, t, :] == h[None, :, t, :]).all(axis=2)
            if np.take_along_axis(hit, near, axis=1).mean() >= recall and hit.mean() <= SHARE:
                return models[w], m, tables
    return None


def similar_vectors(queries: DataFrame, corpus: DataFrame, k: int = 5, query_id: str = "query_id", item_id: str = "vec_id",
                    vector: str = "embedding", exclude_self: bool = False, recall: float = 0.95) -> DataFrame:
    """As ``search.similar_vectors``, whose answers it gives for at least about
    ``recall`` of the neighbours; scores are exact, ties go to the smaller id.

    Vectors of the corpus travel once per table in which a query shares their
    bucket. A bucket of very many vectors or queries meets block by block, and a
    block pair gives its k best per query only.
    """
    spark = corpus.sparkSession
    ship_package(spark)
    own, asked = cut_lineage(_directions(corpus, item_id, vector)), cut_lineage(_directions(queries, query_id, vector))
    chosen = choose(own, k, recall)
    if chosen is None:
        return search.similar_vectors(queries, corpus, k, query_id, item_id, vector, exclude_self)
    model, m, tables = chosen
    keyed = lambda df: model.transform(df).select("id", "v", F.inline(_hashes(m, tables)))
    q = keyed(asked)
    met = cut_lineage(q.groupBy("t", "key").agg(F.count("*").alias("n_q")))
    # grouped and wrapped, so that joins with a bucket that holds very many can be split
    c = cut_lineage(keyed(own).join(met.select("t", "key"), ["t", "key"], "left_semi"))
    sizes = (c.groupBy(F.struct("t", "key").alias("b")).agg(F.count("*").alias("n_c")).select("b.t", "b.key", "n_c")
             .join(met, ["t", "key"]).select("t", "key", F.ceil(F.col("n_c") / BLOCK).cast("int").alias("cs"), F.ceil(F.col("n_q") / BLOCK).cast("int").alias("qs")))
    sizes = cut_lineage(sizes)
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = q.join(sizes, ["t", "key"]).withColumn("qb", block("qs")).withColumn("cb", upto("cs")).select("t", "key", "qb", "cb", "id", "v")
    right = c.join(sizes, ["t", "key"]).withColumn("cb", block("cs")).withColumn("qb", upto("qs")).select("t", "key", "qb", "cb", "id", "v")

    def score(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        if not len(qs) or not len(cs):
            return none
        cs = cs.sort_values("id", kind="stable")
        a, b = np.array(qs["v"].tolist()), np.array(cs["v"].tolist())
        a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
        ids, own_ids = cs["id"].to_numpy(), qs["id"].to_numpy()
        out = []
        step = max(1, 4_000_000 // len(ids))
        for at in range(0, len(a), step):
            s = np.round(a[at:at + step] @ b.T, search.RANK_DECIMALS) + 0.0
            if exclude_self:
                s[own_ids[at:at + step, None] == ids[None, :]] = -np.inf
            rows, cols = search._best(s, k)
            out.append(pd.DataFrame({"query_id": own_ids[at:at + step][rows], "item_id": ids[cols], "score": s[rows, cols]}))
        return pd.concat(out)

    kinds = dict(asked.dtypes)["id"], dict(own.dtypes)["id"]
    found = (left.groupBy("t", "key", "qb", "cb").cogroup(right.groupBy("t", "key", "qb", "cb"))
             .applyInPandas(score, f"query_id {kinds[0]}, item_id {kinds[1]}, score double"))
    best = cut_lineage(search._global_topk(found.groupBy("query_id", "item_id").agg(F.max("score").alias("score")), k, "query_id", "item_id", "score"))
    full = best.where(F.col("rank") == k).select("query_id")
    poor = queries.join(full, queries[query_id] == full["query_id"], "left_anti")
    hashed = best.join(full, "query_id", "left_semi").select(F.col("query_id").alias(query_id), F.col("item_id").alias(item_id),
                                                             F.col("score").alias("similarity"), F.col("rank").cast("int").alias("rank"))
    if not poor.head(1):
        return hashed
    return hashed.unionByName(search.similar_vectors(poor, corpus, k, query_id, item_id, vector, exclude_self))
