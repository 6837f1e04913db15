"""Similarity search (K1-K5), asset matching (J7) and corpus refresh.

Exact top-k without emitting all (query, item) pairs
----------------------------------------------------
K1 cuts both sides into blocks of bounded size by a hash of the id. Every
query block meets every corpus block once (queries and corpus never pass
through the driver); a task scores one pair of blocks with numpy and carries
a running top-k per query over the pairs it gets, so it emits k rows per query
and task. K2 broadcasts the query terms with their weights, in chunks of a
bounded number of (query, term) pairs; a document's terms are counted within its
row, and each corpus partition carries a running top-k per query. A final window
picks the global top-k. Very many short queries (``bm25_topk_short``) don't meet
every document: those of the same common terms share one search for these.

Scores are rounded to 9 decimals before anything is selected, and equal scores
go to the smaller item id at every step, so neither batch sizes, partitions nor
floating-point summation order can change which items win.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketflow.session import cut_lineage, ship_package, small_batches

RANK_DECIMALS = 9
QUERY_BLOCK = 512            # queries of a block
CORPUS_BLOCK = 4_096         # items of a block
MAX_QUERY_TERMS = 2_000_000  # (query, term) pairs of one broadcast
MAX_BROADCAST_TERMS = 500_000
BATCH = 1_000                # documents that reach Python at once
TRIPLES = 1_000_000          # (document, term, query) triples added up at once
CELLS = 2_000_000            # of a table of scores, of term counts, or of dense weights
DENSE = 16                   # a term of every DENSE-th query or more is weighed by a matrix product
MET_AT_MOST = 1_000_000      # (query, document) pairs that a term of short queries brings together


def _global_topk(partial: DataFrame, k: int, qid: str, item: str, score: str) -> DataFrame:
    w = Window.partitionBy(qid).orderBy(F.col(score).desc(), F.col(item).asc())
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of each row's k best finite scores, ties to the smaller column."""
    k = min(k, scores.shape[1])
    if k == 0 or scores.shape[0] == 0:
        return np.empty(0, dtype=int), np.empty(0, dtype=int)
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    rows, cols = np.nonzero((scores >= kth[:, None]) & np.isfinite(scores))
    order = np.lexsort((cols, -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], cols[place < k]


class _RunningTop:
    """The k best (score, item) per query over all batches of a partition."""

    def __init__(self, k: int):
        self.k, self.best = k, {}

    def add(self, query, pairs: list[tuple]) -> None:
        """``pairs``: (-score, item), at most k of one batch."""
        old = self.best.get(query)
        self.best[query] = heapq.nsmallest(self.k, old + pairs) if old else pairs

    def add_batch(self, queries, items: np.ndarray, scores: np.ndarray) -> None:
        """``items`` in ascending order; scores is queries x items."""
        rows, cols = _best(scores, self.k)
        ends = np.searchsorted(rows, np.arange(scores.shape[0] + 1))
        for q in range(scores.shape[0]):
            a, b = ends[q], ends[q + 1]
            if b > a:
                self.add(queries[q], list(zip((-scores[q, cols[a:b]]).tolist(), items[cols[a:b]].tolist())))

    def frame(self) -> pd.DataFrame:
        rows = [(q, i, -s) for q, best in self.best.items() for s, i in best]
        return pd.DataFrame(rows, columns=["query_id", "item_id", "score"])


# ---------------------------------------------------------------- K1

def _blocks_of(df: DataFrame, block_rows: int, name: str) -> tuple[DataFrame, int]:
    """(one row per block with its members sorted by id, number of blocks) of (id, v)."""
    n = max(1, math.ceil(df.count() / block_rows))
    return (df.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(name))
            .agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias(f"{name}_rows"))), n


def similar_vectors(queries: DataFrame, corpus: DataFrame, k: int = 5, query_id: str = "query_id",
                    item_id: str = "vec_id", vector: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """K1: exact cosine top-k of ``corpus`` items per query vector.

    ``exclude_self`` drops the item whose id equals the query id (for a
    corpus searched with its own rows). Zero vectors get no similarity and
    never rank. Ids may be of any type that sorts. Filter the corpus first for
    K4 attribute filters.
    """
    spark = corpus.sparkSession
    ship_package(spark)
    q = queries.select(F.col(query_id).alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    c = corpus.select(F.col(item_id).alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    qb, n_query_blocks = _blocks_of(q, QUERY_BLOCK, "qb")
    cb, n_corpus_blocks = _blocks_of(c, CORPUS_BLOCK, "cb")
    # a task keeps one query block and meets a share of the corpus blocks
    shares = max(1, min(n_corpus_blocks, math.ceil(4 * spark.sparkContext.defaultParallelism / n_query_blocks)))
    pairs = (cb.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1)))).join(qb, "qb")
             .repartition(n_query_blocks * shares, "qb", F.pmod("cb", F.lit(shares))))

    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def score(batches):
        top = _RunningTop(k)
        for pdf in batches:
            for own, items in zip(pdf["qb_rows"], pdf["cb_rows"]):
                qids = [r["id"] for r in own]
                ids = np.array([r["id"] for r in items], dtype=object)
                qm = unit(np.array([r["v"] for r in own], dtype=np.float64))
                m = unit(np.array([r["v"] for r in items], dtype=np.float64))
                s = np.round(qm @ m.T, RANK_DECIMALS) + 0.0
                s[:, ~m.any(axis=1)] = -np.inf
                s[~qm.any(axis=1), :] = -np.inf
                if exclude_self:
                    s[np.array(qids, dtype=object)[:, None] == ids[None, :]] = -np.inf
                top.add_batch(qids, ids, s)
        yield top.frame()

    kinds = dict(q.dtypes)["id"], dict(c.dtypes)["id"]
    partial = pairs.mapInPandas(score, f"query_id {kinds[0]}, item_id {kinds[1]}, score double")
    top = _global_topk(partial, k, "query_id", "item_id", "score")
    return top.select(F.col("query_id").alias(query_id), F.col("item_id").alias(item_id),
                      F.col("score").alias("similarity"), F.col("rank").cast("int").alias("rank"))


# ---------------------------------------------------------------- K2

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
BM25_K1, BM25_B = 1.2, 0.75


def char_ngrams(text: Column, n: int) -> Column:
    """The character n-grams of a text in order; a shorter text is one.

    The characters are bound once, as the element of a one-element array: a lambda
    that held the text itself would compute it, and count its way into it, anew for
    every position."""
    def of(c: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(c) - F.lit(n - 1)), lambda i: F.array_join(F.slice(c, i, n), ""))
        return F.when(F.size(c) < n, F.array(F.array_join(c, ""))).otherwise(made)
    return F.get(F.transform(F.array(F.split(text, "")), of), F.lit(0))


def tokens(text_col: str = "text", ngram: int = 0):
    """Lower-cased word tokens; with ``ngram`` > 0, character n-grams of the
    whitespace-collapsed text instead (scripts written without spaces)."""
    t = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    if ngram <= 0:
        return F.filter(F.split(t, TOKEN_SPLIT), lambda x: x != "")
    return char_ngrams(F.regexp_replace(t, r"\s+", " "), ngram)


def _plain(text_col: str, ngram: int) -> Column:
    """The text that ``_split`` cuts into the tokens of ``tokens``."""
    t = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    # tokens hold letters and digits only, so a blank can part them
    return F.regexp_replace(t, TOKEN_SPLIT, " ") if ngram <= 0 else F.regexp_replace(t, r"\s+", " ")


def _split(plain: str, ngram: int) -> list[str]:
    if ngram <= 0:
        return [w for w in plain.split(" ") if w]
    return [plain[i:i + ngram] for i in range(len(plain) - ngram + 1)] or [plain]


def _counted(docs: DataFrame, ngram: int, terms: dict[str, int]) -> DataFrame:
    """(d, dl, ts, tfs) of (d, text): a document's length in tokens, and the numbers
    and occurrences of those of its tokens that ``terms`` numbers. They are counted
    within the row, so no (document, term) row is shuffled."""
    spark = docs.sparkSession
    small_batches(spark, BATCH)
    bw = spark.sparkContext.broadcast(terms)

    def count(batches):
        number = bw.value
        for pdf in batches:
            lengths, ts, tfs = [], [], []
            for text in pdf["text"]:
                words = _split(text, ngram)
                own = [(number[w], n) for w, n in Counter(words).items() if w in number]
                lengths.append(len(words))
                ts.append([t for t, _ in own])
                tfs.append([n for _, n in own])
            yield pd.DataFrame({"d": pdf["d"], "dl": lengths, "ts": ts, "tfs": tfs})

    kind = docs.schema["d"].dataType.simpleString()
    return docs.select("d", _plain("text", ngram).alias("text")).mapInPandas(count, f"d {kind}, dl int, ts array<int>, tfs array<int>")


def term_counts(docs: DataFrame, ngram: int = 0) -> DataFrame:
    """(doc_id, live, dl, own, tfs) of (doc_id, text): whether there is a text, its
    length in tokens, its different tokens and how often each occurs."""
    small_batches(docs.sparkSession, BATCH)

    def count(batches):
        for pdf in batches:
            every = [_split(text, ngram) if live else [] for text, live in zip(pdf["text"], pdf["live"])]
            counts = [Counter(words) for words in every]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "live": pdf["live"], "dl": [len(words) for words in every],
                                "own": [list(c) for c in counts], "tfs": [list(c.values()) for c in counts]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").isNotNull().alias("live"), _plain("text", ngram).alias("text"))
    return rows.mapInPandas(count, f"doc_id {kind}, live boolean, dl long, own array<string>, tfs array<long>")


def numbered(counts: DataFrame, terms: dict[str, int]) -> DataFrame:
    """(d, dl, ts, tfs) of rows of ``term_counts``: of the tokens that ``terms`` numbers."""
    spark = counts.sparkSession
    small_batches(spark, BATCH)
    bw = spark.sparkContext.broadcast(terms)

    def keep(batches):
        number = bw.value
        for pdf in batches:
            ts, tfs = [], []
            for own, n in zip(pdf["own"], pdf["tfs"]):
                pairs = [(number[w], m) for w, m in zip(own, n) if w in number]
                ts.append([t for t, _ in pairs])
                tfs.append([m for _, m in pairs])
            yield pd.DataFrame({"d": pdf["doc_id"], "dl": pdf["dl"], "ts": ts, "tfs": tfs})

    kind = counts.schema["doc_id"].dataType.simpleString()
    return counts.select("doc_id", "dl", "own", "tfs").mapInPandas(keep, f"d {kind}, dl long, ts array<int>, tfs array<long>")


def _merged(per_doc: DataFrame) -> tuple[DataFrame, int, float]:
    """(per_doc, documents, average length): rows of one id and length are one document."""
    heads = per_doc.groupBy(F.struct("d", "dl").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    n, avgdl, most = heads.agg(F.count(F.lit(1)), F.avg("k.dl"), F.max("n")).first()
    if most and most > 1:
        pairs = per_doc.select("d", "dl", F.explode(F.arrays_zip("ts", "tfs")).alias("e"))
        summed = pairs.groupBy("d", "dl", F.col("e.ts").alias("t")).agg(F.sum("e.tfs").alias("tf"))
        per_doc = cut_lineage(_gathered(summed))
    return per_doc, int(n), float(avgdl or 0.0)


def _gathered(postings: DataFrame) -> DataFrame:
    """(d, dl, ts, tfs) of (d, dl, t, tf)."""
    return (postings.groupBy("d", "dl").agg(F.collect_list(F.struct("t", "tf")).alias("p"))
            .select("d", "dl", F.transform("p", lambda e: e["t"]).alias("ts"), F.transform("p", lambda e: e["tf"]).alias("tfs")))


def _weights(qterms: DataFrame, dfreq: DataFrame, n_docs: int) -> DataFrame:
    """(qid, term, w, df): idf times the query's occurrences, of terms that documents have."""
    return (qterms.join(dfreq, "term")
            .withColumn("idf", F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0))
            .select("qid", "term", (F.col("idf") * F.col("qtf")).alias("w"), "df"))


def _ranked_postings(qterms: DataFrame, postings: DataFrame, dfreq: DataFrame, n_docs: int, avgdl: float, k: int, schema: str,
                     k1: float, b: float) -> DataFrame | None:
    """The k best documents per query of every partition, from postings (d, dl,
    term, tf) and document frequencies; None where no query term occurs."""
    spark = postings.sparkSession
    wpdf = _weights(qterms, dfreq, n_docs).toPandas()  # bounded by the chunk's (query, term) pairs
    if len(wpdf) == 0:
        return None
    terms = {t: i for i, t in enumerate(sorted(wpdf["term"].unique().tolist()))}
    tdict = spark.createDataFrame(pd.DataFrame({"term": list(terms), "t": np.arange(len(terms), dtype=np.int64)}))
    hint = F.broadcast(tdict) if len(terms) <= MAX_BROADCAST_TERMS else tdict
    per_doc = _gathered(postings.join(hint, "term").select("d", "dl", "t", "tf"))
    return _ranked(wpdf, terms, per_doc, avgdl, k, schema, k1, b)


def _ranked(wpdf: pd.DataFrame, terms: dict[str, int], per_doc: DataFrame, avgdl: float, k: int, schema: str, k1: float, b: float) -> DataFrame:
    """The k best documents per query of every partition, from weights (qid, term,
    w) and documents (d, dl, ts, tfs) whose terms ``terms`` numbers.

    Terms of many queries are weighed by a product of two dense matrices of
    bounded size, the others by adding up a bounded number of (document, term,
    query) triples at once."""
    spark = per_doc.sparkSession
    small_batches(spark, BATCH)
    # sparse weights: the queries of term t are at qpos[ptr[t]:ptr[t + 1]]
    qids = sorted(wpdf["qid"].unique().tolist())
    at = {q: i for i, q in enumerate(qids)}
    t = np.array([terms[x] for x in wpdf["term"]], dtype=np.int64)
    qpos = np.array([at[x] for x in wpdf["qid"]], dtype=np.int64)
    w = wpdf["w"].to_numpy(dtype=np.float64)
    asked = np.bincount(t, minlength=len(terms))  # queries of a term
    dense = np.argsort(-asked, kind="stable")[:CELLS // max(1, len(qids))]
    dense = dense[(asked[dense] * DENSE >= len(qids)) & (asked[dense] > 1)]
    place = np.full(len(terms), -1, dtype=np.int64)  # of a term in the dense weights
    place[dense] = np.arange(len(dense))
    table = np.zeros((len(dense), len(qids)))
    some = place[t] >= 0
    table[place[t[some]], qpos[some]] = w[some]
    t, qpos, w = t[~some], qpos[~some], w[~some]
    order = np.lexsort((qpos, t))
    ptr = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=len(terms)))])
    bw = spark.sparkContext.broadcast((qids, place, table, ptr, qpos[order], w[order]))

    def score(batches, bw=bw, avgdl=avgdl):
        ids, place, table, ptr, qpos, w = bw.value
        top = _RunningTop(k)
        rows_at_once = max(1, CELLS // max(len(ids), len(table)))
        for pdf in batches:
            pdf = pdf[pdf["ts"].map(len) > 0].sort_values("d", kind="stable")
            for j in range(0, len(pdf), rows_at_once):
                some = pdf.iloc[j:j + rows_at_once]
                doc = np.repeat(np.arange(len(some)), some["ts"].map(len).to_numpy())
                ts = np.concatenate(some["ts"].to_numpy()).astype(np.int64)
                tf = np.concatenate(some["tfs"].to_numpy()).astype(np.float64)
                norm = k1 * (1 - b + b * (some["dl"].to_numpy(dtype=np.float64) / avgdl if avgdl > 0 else 0.0))
                v = tf * (k1 + 1) / (tf + norm[doc])
                at = place[ts]
                often = at >= 0
                x = np.zeros((len(some), len(table)))
                x[doc[often], at[often]] = v[often]
                s = (x @ table).ravel()
                doc, ts, v = doc[~often], ts[~often], v[~often]
                counts = ptr[ts + 1] - ptr[ts]
                upto = np.cumsum(counts)
                p = 0
                while p < len(ts):  # a bounded number of triples at once, one term of a document at least
                    end = max(p + 1, int(np.searchsorted(upto, (upto[p - 1] if p else 0) + TRIPLES, side="right")))
                    c = counts[p:end]
                    ends = np.cumsum(c)
                    flat = np.arange(ends[-1]) - np.repeat(ends - c, c) + np.repeat(ptr[ts[p:end]], c)
                    np.add.at(s, np.repeat(doc[p:end], c) * len(ids) + qpos[flat], w[flat] * np.repeat(v[p:end], c))
                    p = end
                s = np.round(s.reshape(len(some), len(ids)).T, RANK_DECIMALS)
                s[s <= 0] = -np.inf  # no shared term: the document does not rank for that query
                top.add_batch(ids, some["d"].to_numpy(dtype=object), s)
        yield top.frame()

    return per_doc.mapInPandas(score, schema)


def _postings(d: DataFrame, term_set: DataFrame, ngram: int) -> tuple[DataFrame, int, float]:
    """(postings (term, d, dl, tf), documents, average length) of (d, text), for the terms of ``term_set``."""
    d = d.select("d", tokens("text", ngram).alias("toks"))
    dl = F.size("toks").alias("dl")
    kept = (d.select("d", dl, F.explode("toks").alias("term")).join(term_set, "term").select("term", "d", "dl")
            .unionByName(d.select(F.lit(None).cast("string").alias("term"), "d", dl)))
    # read three times (statistics, document frequencies, scoring): materialize once in the
    # shared checkpoint folder instead of tokenizing the corpus again
    postings = cut_lineage(kept.groupBy("d", "dl", "term").agg(F.count(F.lit(1)).alias("tf")))
    stats = postings.where(F.col("term").isNull()).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    return postings.where(F.col("term").isNotNull()), int(stats["n"]), float(stats["avgdl"] or 0.0)


def _document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _asked_terms(queries: DataFrame, query_id: str, text: str, ngram: int) -> DataFrame:
    return cut_lineage(queries.select(F.col(query_id).alias("qid"), F.explode(tokens(text, ngram)).alias("term"))
                       .groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf")))


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int = 5, query_id: str = "query_id",
              doc_id: str = "doc_id", text: str = "text", ngram: int = 0, k1: float = BM25_K1,
              b: float = BM25_B, max_pairs: int = MAX_QUERY_TERMS) -> DataFrame:
    """K2: exact BM25 top-k documents per query text.

    For the query terms only: a document's (term, tf) pairs are counted within its
    row (bounded by the number of distinct query terms); Spark sums document
    frequencies and the corpus statistics (N, avgdl). Documents are scored in
    ``mapInPandas`` against the queries that have the term, and only a running
    top-k per query leaves the partition.
    idf = ln((N - df + 0.5) / (df + 0.5) + 1). Ids may be of any type that sorts.

    Queries are taken in chunks of about ``max_pairs`` (query, term) pairs, which
    bounds the broadcast weights; each chunk is one more pass over the corpus. A
    chunk of more than ``MAX_BROADCAST_TERMS`` terms is joined with the documents' tokens.
    """
    spark = docs.sparkSession
    ship_package(spark)
    d = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("text"))
    all_terms = _asked_terms(queries, query_id, text, ngram)
    parts = max(1, math.ceil(all_terms.count() / max_pairs))
    kinds = dict(queries.dtypes)[query_id], dict(docs.dtypes)[doc_id]
    schema = f"query_id {kinds[0]}, item_id {kinds[1]}, score double"
    out = []
    for part in range(parts):
        qterms = all_terms.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part)
        term_set = cut_lineage(qterms.select("term").distinct())
        if term_set.count() <= MAX_BROADCAST_TERMS:
            terms = {r["term"]: i for i, r in enumerate(term_set.collect())}
            # read three times, as postings are below
            per_doc, n_docs, avgdl = _merged(cut_lineage(_counted(d, ngram, terms)))
            number = spark.createDataFrame(list(terms.items()), "term string, t int")
            dfreq = per_doc.select(F.explode("ts").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(number), "t").select("term", "df")
            wpdf = _weights(qterms, dfreq, n_docs).toPandas()  # bounded by the chunk's (query, term) pairs
            found = _ranked(wpdf, terms, per_doc, avgdl, k, schema, k1, b) if len(wpdf) else None
        else:
            postings, n_docs, avgdl = _postings(d, term_set, ngram)
            found = _ranked_postings(qterms, postings, _document_frequencies(postings), n_docs, avgdl, k, schema, k1, b)
        if found is not None:
            out.append(found)
    if not out:
        return spark.createDataFrame([], f"{query_id} {kinds[0]}, {doc_id} {kinds[1]}, score double, rank int")
    partial = reduce(lambda a, b_: a.unionByName(b_), out)
    return _named(_global_topk(partial, k, "query_id", "item_id", "score"), query_id, doc_id)


def _named(top: DataFrame, query_id: str, doc_id: str) -> DataFrame:
    return top.select(F.col("query_id").alias(query_id), F.col("item_id").alias(doc_id),
                      F.col("score").alias("score"), F.col("rank").cast("int").alias("rank"))


def bm25_topk_short(queries: DataFrame, docs: DataFrame, k: int = 5, query_id: str = "query_id", doc_id: str = "doc_id",
                    text: str = "text", k1: float = BM25_K1, b: float = BM25_B, met_at_most: int = MET_AT_MOST) -> DataFrame:
    """K2 for very many short queries over word tokens: the rows of ``bm25_topk``.

    A term is common if its queries times its documents exceed ``met_at_most``.
    Queries of the same common terms share one search for these. A query's rare
    terms bring it the documents that have one, which are scored over all its
    terms. No other document has more than its common terms give, and a document
    among the k best that has no rare term is among the k best by the common ones:
    what a rare term adds is above zero and moves only other documents up.
    """
    spark = docs.sparkSession
    ship_package(spark)
    d = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("text"))
    asked = _asked_terms(queries, query_id, text, 0)
    postings, n_docs, avgdl = _postings(d, asked.select("term").distinct(), 0)
    weights = _weights(asked, _document_frequencies(postings), n_docs)
    often = asked.groupBy("term").agg((F.count(F.lit(1)) * F.lit(1.0)).alias("asked"))
    weights = cut_lineage(weights.join(asked, ["qid", "term"]).join(often, "term")
                          .select("qid", "term", "qtf", "w", "df", (F.col("asked") * F.col("df") > met_at_most).alias("common")))
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * (F.col("dl") / F.lit(avgdl) if avgdl > 0 else F.lit(0.0)))
    gain = F.col("tf") * F.lit(k1 + 1) / (F.col("tf") + norm)
    held = postings.select("term", F.struct("d", "dl").alias("doc"), gain.alias("gain"))
    kinds = dict(queries.dtypes)[query_id], dict(docs.dtypes)[doc_id]

    rare = weights.where(~F.col("common")).select("qid", "term")
    met = rare.join(held, "term").select("qid", "doc").distinct()
    full = (met.join(weights.select("qid", "term", "w"), "qid").join(held, ["doc", "term"])
            .groupBy("qid", "doc").agg(F.round(F.sum(F.col("w") * F.col("gain")), RANK_DECIMALS).alias("score")))
    full = cut_lineage(full.select(F.col("qid").alias("query_id"), F.col("doc.d").alias("item_id"), "score"))

    # queries of equal common terms are one query, named by these
    same = (weights.where("common").groupBy(F.struct("qid").alias("k")).agg(F.array_sort(F.collect_list(F.struct("term", "qtf"))).alias("terms"))
            .select(F.col("k.qid").alias("query_id"), F.sha2(F.to_json("terms"), 256).alias("name"), "terms"))
    same = cut_lineage(same)
    once = same.groupBy("name").agg(F.first("terms").alias("terms")).select(F.col("name").alias("qid"), F.inline("terms"))
    common = _ranked_postings(once, postings.join(once.select("term").distinct(), "term"), _document_frequencies(postings), n_docs, avgdl, k,
                              f"query_id string, item_id {kinds[1]}, score double", k1, b)
    both = full
    if common is not None:
        best = _global_topk(common, k, "query_id", "item_id", "score").select(F.struct("item_id", "score").alias("r"), F.col("query_id").alias("name"))
        shared = best.groupBy(F.struct("name").alias("k")).agg(F.collect_list("r").alias("rows")).select(F.col("k.name").alias("name"), "rows")
        by_common = same.select("query_id", "name").join(shared, "name").select("query_id", F.inline("rows"))
        both = full.unionByName(by_common.join(full.select("query_id", "item_id").distinct(), ["query_id", "item_id"], "left_anti")
                                .select("query_id", "item_id", "score"))
    return _named(_global_topk(both.where("score > 0"), k, "query_id", "item_id", "score"), query_id, doc_id)


# ---------------------------------------------------------------- K3

RRF_K = 60


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int = 5, query_id: str = "query_id",
                           item_id: str = "doc_id", c: int = RRF_K) -> DataFrame:
    """K3 (re-aimed): fuse ranked lists by sum(1 / (c + rank)); top-k per query."""
    parts = [r.select(query_id, item_id, (F.lit(1.0) / (F.lit(c) + F.col("rank"))).alias("rrf"))
             for r in rankings]
    fused = reduce(lambda a, b: a.unionByName(b), parts).groupBy(query_id, item_id).agg(
        F.sum("rrf").alias("rrf_score"))
    w = Window.partitionBy(query_id).orderBy(F.round("rrf_score", RANK_DECIMALS).desc(), F.col(item_id))
    return fused.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)


# ---------------------------------------------------------------- K5

def near_duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """K5 (exact part): documents with identical normalized text share a group;
    the group id is the smallest member id.

    Texts are normalized and hashed once. The aggregate is grouped by a
    wrapped key, so the join has exchanges of its own and adaptive execution
    can split a group that holds a third of all rows.
    """
    norm = F.regexp_replace(F.lower(F.trim(F.coalesce(F.col(text), F.lit("")))), r"\s+", " ")
    h = cut_lineage(docs.select(F.col(doc_id).alias("id"), F.sha2(norm, 256).alias("s")))
    g = (h.groupBy(F.struct("s").alias("k")).agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("group_size"))
         .select(F.col("k.s").alias("s"), "group_id", "group_size"))
    return h.join(g, "s").select(F.col("id").alias(doc_id), "group_id", "group_size")


# ---------------------------------------------------------------- J7

def match_asset(tickets: DataFrame, assets: DataFrame, k: int = 5, by: str = "location") -> DataFrame:
    """Up to k ACTIVE assets of the reporter (assignee = reporter_name and
    the same ``by`` column: location, or department), by asset_id.

    Assets are cut to their first k per (assignee, by) before the join
    (``row_number() <= k`` is planned with a partial group limit), so a
    person owning many assets cannot fan the join out: each ticket meets at
    most k rows, which are exactly its top k. They are then gathered per owner
    under a wrapped key: the join has exchanges of its own on both sides, and a
    reporter with a third of all tickets is split.
    """
    a = assets.where(F.col("status") == "ACTIVE").where(F.col("assignee").isNotNull())
    w = Window.partitionBy("assignee", by).orderBy("asset_id")
    a = a.withColumn("asset_rank", F.row_number().over(w)).where(F.col("asset_rank") <= k)
    owned = (a.groupBy(F.struct(F.col("assignee").alias("who"), F.col(by).alias("at")).alias("_k"))
             .agg(F.collect_list(F.struct("asset_id", "asset_type", F.col("asset_rank").cast("int").alias("asset_rank"))).alias("_assets"))
             .select(F.col("_k.who").alias("_who"), F.col("_k.at").alias("_by"), "_assets"))
    t = tickets.select("ticket_id", "reporter_name", F.col(by).alias("_tby"))
    return t.join(owned, (F.col("reporter_name") == F.col("_who")) & (F.col("_tby") == F.col("_by"))).select("ticket_id", F.inline("_assets"))


def find_asset(tickets: DataFrame, assets: DataFrame, search_text: Column, k: int = 5, by: str = "location") -> DataFrame:
    """J7 with its fallback: ``match_asset`` where it finds any, else the ``k``
    active assets whose text (``asset_text`` column) ranks highest for the
    reporter and the ``by`` value, as the asset search is asked.

    ticket_id, asset_id, asset_type, asset_rank, found_by (owner or text).
    Unmatched tickets are searched once per different search text, however many
    share it, and texts of the same common words (a place) share their search. A ticket whose text shares no term with an active asset has no row.
    """
    owned = cut_lineage(match_asset(tickets, assets, k, by))
    left = tickets.join(owned.select("ticket_id"), "ticket_id", "left_anti").select("ticket_id", search_text.alias("text"))
    asked = cut_lineage(left.where(F.col("text").isNotNull()))
    # a query is named by its text; its tickets come back by a join that can be split
    queries = asked.select("text").distinct().select(F.col("text").alias("query_id"), "text")
    active = assets.where(F.col("status") == "ACTIVE").select("asset_id", F.col("asset_text").alias("text"))
    found = bm25_topk_short(queries, active, k, doc_id="asset_id")
    per_text = (found.join(assets.select("asset_id", "asset_type"), "asset_id")
                .groupBy(F.struct("query_id").alias("_k")).agg(F.collect_list(F.struct("asset_id", "asset_type", F.col("rank").alias("asset_rank"))).alias("_assets"))
                .select(F.col("_k.query_id").alias("text"), "_assets"))
    by_text = asked.join(per_text, "text").select("ticket_id", F.inline("_assets"))
    return owned.withColumn("found_by", F.lit("owner")).unionByName(by_text.withColumn("found_by", F.lit("text")))


# ---------------------------------------------------------------- S10

def upsert_corpus(current: DataFrame, changes: DataFrame, key: str = "id",
                  order_col: str = "updated_at") -> DataFrame:
    """Apply a batch of changed documents: the newest row per key wins,
    stored or changed (a change wins a tie); unchanged rows pass."""
    cols = current.columns
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.select(*cols).withColumn("_new", F.lit(1)))
    newest = F.max_by(F.struct(*cols), F.struct(order_col, "_new")).alias("_r")
    return both.groupBy(F.col(key).alias("_key")).agg(newest).select("_r.*")
