"""A stored text index that changes with its corpus (S10) and answers K2 searches.

Two state tables: the documents' postings (the terms a document has put into the
index, how often each occurs, and its length; one row per document), and document
frequencies. A batch of changed documents replaces their rows and takes what the
old ones put in out of the frequencies, so its work follows the batch, and a search
reads term counts instead of texts. A document's terms are counted and stored within
its row: no row per (term, document) is shuffled or written. Numbers over the whole
corpus (documents, length) are published with the batch.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketflow.operators import search
from ticketflow.session import cut_lineage, ship_package, stage, unstage
from ticketflow.streaming import sinks
from ticketflow.streaming.state_table import StateTable


class TextIndex:
    """An index under ``base`` over word tokens, or over character n-grams with
    ``ngram`` > 0 (scripts written without spaces)."""

    def __init__(self, spark: SparkSession, base: str, ngram: int = 0, buckets: int = 16):
        self.spark, self.base, self.ngram = spark, base.rstrip("/"), ngram
        self.terms = StateTable(spark, f"{self.base}/terms", ["doc_id"], buckets=buckets)
        self.frequencies = StateTable(spark, f"{self.base}/frequencies", ["term"], buckets=buckets)

    def update(self, changed: DataFrame, batch_id: int, doc_id: str = "doc_id", text: str = "text", order_col: str | None = None) -> None:
        """Take in a batch of documents: new ones, new texts of known ones, and
        (null text) documents that go. Of several rows for one id the newest by
        ``order_col`` counts; without it several are an error.

        The terms table is published last and is what makes the batch done: a
        replay before that finds the old terms still there, and the tables
        already published skip it.
        """
        if sinks.committed(self.spark, self.terms.base, batch_id):
            return
        one = StateTable(self.spark, self.base, ["doc_id"], order_col)
        rows = changed.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *([order_col] if order_col else [])).where(F.col("doc_id").isNotNull())
        ship_package(self.spark)
        new = stage(search.term_counts(one.newest(rows).select("doc_id", "text"), self.ngram))
        known = self.terms.read_keys(new)
        old = None if known is None else stage(known)
        if not sinks.committed(self.spark, self.frequencies.base, batch_id):
            moved = new.select(F.explode("own").alias("term"), F.lit(1).cast("long").alias("df"))
            if old is not None:
                moved = moved.unionByName(old.select(F.explode("own").alias("term"), F.lit(-1).cast("long").alias("df")))
            delta = stage(moved.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"))
            stored = self.frequencies.read_keys(delta)
            total = delta if stored is None else delta.unionByName(stored).groupBy("term").agg(F.sum("df").alias("df"))
            total = stage(total)
            self.frequencies.upsert(total, batch_id)
            unstage(delta, total)
        sums = lambda df: df.agg(F.coalesce(F.sum(F.col("live").cast("long")), F.lit(0)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        n, length = sums(new)
        n0, length0 = (0, 0) if old is None else sums(old)
        held = self.terms.extra()
        self.terms.upsert(new, batch_id, extra={"docs": held.get("docs", 0) + n - n0, "length": held.get("length", 0) + length - length0})
        unstage(new, *([] if old is None else [old]))

    def topk(self, queries: DataFrame, k: int = 5, query_id: str = "query_id", text: str = "text", k1: float = search.BM25_K1,
             b: float = search.BM25_B, max_pairs: int = search.MAX_QUERY_TERMS) -> DataFrame:
        """K2 over the published index: as ``search.bm25_topk`` over the same documents."""
        ship_package(self.spark)
        held, kind = self.terms.extra(), dict(queries.dtypes)[query_id]
        n_docs = held.get("docs", 0)
        rows = self.terms.read()
        doc_kind = "string" if rows is None else dict(rows.dtypes)["doc_id"]
        schema = f"query_id {kind}, item_id {doc_kind}, score double"
        partial = self.spark.createDataFrame([], schema)
        if rows is not None and n_docs:
            asked = cut_lineage(queries.select(F.col(query_id).alias("qid"), F.explode(search.tokens(text, self.ngram)).alias("term"))
                                .groupBy("qid", "term").agg(F.count("*").alias("qtf")))
            parts = max(1, math.ceil(asked.count() / max_pairs))
            for part in range(parts):  # bounded chunks of (query, term) pairs, as in the search without an index
                own = asked.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part)
                wanted = cut_lineage(own.select("term").distinct())
                dfreq = self.frequencies.read().where("df > 0")
                if wanted.count() <= search.MAX_BROADCAST_TERMS:
                    terms = {r["term"]: i for i, r in enumerate(wanted.collect())}
                    weights = search._weights(own, dfreq, n_docs).toPandas()  # bounded by the chunk's pairs
                    found = search._ranked(weights, terms, search.numbered(rows, terms), held["length"] / n_docs, k, schema, k1, b) if len(weights) else None
                else:
                    posts = rows.select(F.col("doc_id").alias("d"), "dl", F.explode(F.arrays_zip("own", "tfs")).alias("e")).select("d", "dl", F.col("e.own").alias("term"), F.col("e.tfs").alias("tf"))
                    found = search._ranked_postings(own, posts.join(wanted, "term"), dfreq, n_docs, held["length"] / n_docs, k, schema, k1, b)
                if found is not None:
                    partial = partial.unionByName(found)
        top = search._global_topk(partial, k, "query_id", "item_id", "score")
        return top.select(F.col("query_id").alias(query_id), F.col("item_id").alias("doc_id"), "score", F.col("rank").cast("int").alias("rank"))
