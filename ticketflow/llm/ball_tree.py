"""Exact ranked lexical search, by sparse ball trees.

Documents are sparse vectors of saturated term frequencies, items sparse vectors
of term counts times weights, and a score is their inner product. Each task cuts
its documents into trees of bounded size. A node has a centroid c, a radius r
around it and a radius per term, d: how far any of its documents exceeds the
centroid in that term. So no document below it scores more than q.c + |q| r, nor
more than q.c + q.d; texts are sparse, and it is the second that prunes them.
Both vectors are scaled by the square root of the weights, which makes rare terms
decide the radius. A query walks a tree best-first and stops where the bound,
rounded up by more than floating point can lose, is below its k-th score. Leaves
are scored in 64-bit integers. Items are searched in blocks of a bounded number
of terms.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ticketflow.functions.skew import running_sum_within
from ticketflow.session import cut_lineage
from .common import Staged, prepare, text_bytes

BLOCK_TERMS = 400_000     # (item, term) pairs of a block: what a task holds of the items
TREE_ENTRIES = 1_500_000  # (document, term) pairs of a tree
LEAF = 32                 # documents of a leaf
SLACK = 1e-9              # relative; sums of n terms lose at most about n * 1.2e-16, n below 4 million

# Bytes to what a term keeps of them: digits, lower-case letters and all bytes of other scripts.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PART = 1 << 20           # bytes of a text split at once


def term_parts(data: bytes):
    """The terms of a UTF-8 text, part by part."""
    data, at = data.translate(_TERM), 0
    while len(data) - at > _PART:
        end = data.find(b" ", at + _PART)
        if end < 0:
            break
        yield data[at:end].split()
        at = end
    yield data[at:].split()


class BallTree:
    """A tree over documents (rows ``ptr[i]:ptr[i + 1]`` of term numbers and scaled values)."""

    def __init__(self, ptr: np.ndarray, term: np.ndarray, value: np.ndarray, leaf: int = LEAF):
        self.ptr, self.term, self.value, self.leaf = ptr, term, value, leaf
        self.norm2 = np.add.reduceat(value * value, ptr[:-1]) if len(ptr) > 1 else np.zeros(0)
        self.rows = np.arange(len(ptr) - 1)
        self.width = int(term.max()) + 1 if len(term) else 0
        self.nodes: list[tuple] = []  # (first, end, left, right, centroid terms, centroid values, radius, radius per term)
        if len(self.rows):
            self._grow(0, len(self.rows))

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of the rows' entries, which of the rows each belongs to)."""
        n = self.ptr[rows + 1] - self.ptr[rows]
        of = np.repeat(np.arange(len(rows)), n)
        return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.ptr[rows], n), of

    def _grow(self, first: int, end: int) -> int:
        """Append the node of rows[first:end] and those below it; its number."""
        no, rows = len(self.nodes), self.rows[first:end]
        self.nodes.append(())
        at, of = self.entries(rows)
        term, value, m = self.term[at], self.value[at], len(rows)
        dot = lambda dense: np.bincount(of, value * dense[term], m)
        centre = np.bincount(term, value, self.width) / m
        length = float(centre @ centre)
        norm2 = self.norm2[rows]
        # rounded up: the three sums may each be off by their relative slack
        away2 = norm2 - 2 * dot(centre) + length + SLACK * (norm2 + length)
        radius = math.sqrt(max(float(away2.max()), 0.0)) * (1 + SLACK)
        left = right = -1
        if m > self.leaf:
            def row(k):
                dense = np.zeros(self.width)
                a, b = self.ptr[rows[k]], self.ptr[rows[k] + 1]
                dense[self.term[a:b]] = self.value[a:b]
                return dense
            a = row(int(away2.argmax()))
            b = row(int((norm2 - 2 * dot(a)).argmax()))
            self.rows[first:end] = rows[np.argsort(dot(a - b), kind="stable")]
            half = first + m // 2
            left, right = self._grow(first, half), self._grow(half, end)
        some = np.nonzero(centre)[0]
        most = np.zeros(self.width)
        np.maximum.at(most, term, value)
        self.nodes[no] = (first, end, left, right, some, centre[some], radius, most[some] - centre[some])
        return no

    def bound(self, no: int, q: np.ndarray, q_norm: float) -> float:
        """No document below the node has a larger inner product with ``q``."""
        term, value, radius, apart = self.nodes[no][4:]
        own = q[term]
        return (float(own @ value) + min(q_norm * radius, float(own @ apart))) * (1 + SLACK) + 1.0

    def leaves(self, q: np.ndarray, least):
        """Rows of the leaves that may hold a product of ``least()`` or more, best bound first."""
        if not self.nodes:
            return
        norm = math.sqrt(float(q @ q)) * (1 + SLACK)
        todo = [(-self.bound(0, q, norm), 0)]
        while todo:
            top, no = heapq.heappop(todo)
            if -top < least():
                return
            first, end, left, right = self.nodes[no][:4]
            if left < 0:
                yield self.rows[first:end]
            else:
                for child in (left, right):
                    heapq.heappush(todo, (-self.bound(child, q, norm), child))


class _Block:
    """Items of one block: their ids, and their terms as numbers of the block's vocabulary."""

    def __init__(self, rows):
        self.ids = [r["item_id"] for r in rows]
        self.vocabulary: dict[bytes, int] = {}
        self.items = []
        for r in rows:
            numbers = [self.vocabulary.setdefault(bytes(t), len(self.vocabulary)) for t in r["terms"]]
            self.items.append((np.array(numbers, dtype=np.int64), np.array(r["counts"], dtype=np.int64)))


def _items(benchmark: DataFrame, item_col: str, text_col: str, block_terms: int) -> DataFrame:
    """(item_id, terms, counts, block) of the different items that have terms."""
    @F.pandas_udf("terms array<binary>, counts array<long>")
    def count(texts: pd.Series) -> pd.DataFrame:
        out = []
        for data in texts:
            n: Counter = Counter()
            for part in term_parts(data):
                n.update(part)
            out.append((sorted(n), [n[t] for t in sorted(n)]))
        return pd.DataFrame(out, columns=["terms", "counts"])

    items = (benchmark.select(F.col(item_col).cast("long").alias("item_id"), text_bytes(text_col).alias("data")).distinct()
             .select("item_id", count("data").alias("c")).select("item_id", "c.*").where(F.size("terms") > 0))
    numbered = cut_lineage(items.withColumn("row", F.monotonically_increasing_id()).withColumn("n", F.size("terms").cast("long")))
    # an item begins in the block that the pairs before it fill
    placed = running_sum_within(numbered.select("row", "n"), [], ["row"], "n", "upto")
    block = ((F.col("upto") - F.col("n")) / F.lit(block_terms)).cast("long").alias("block")
    return cut_lineage(numbered.join(placed.select("row", block), "row").select("item_id", "terms", "counts", "block"))


def _matches(docs: DataFrame, words) -> DataFrame:
    """(doc_id, n, terms, freqs): a document's length in terms, and which terms of
    the broadcast vocabulary it holds how often."""
    @F.pandas_udf("n long, terms array<int>, freqs array<long>")
    def count(texts: pd.Series) -> pd.DataFrame:
        number, out = words.value.get, []
        for data in texts:
            n, found = 0, Counter()
            for part in term_parts(data):
                n += len(part)
                found.update(map(number, part))
            found.pop(None, None)
            out.append((n, list(found), list(found.values())))
        return pd.DataFrame(out, columns=["n", "terms", "freqs"])

    return docs.select("doc_id", count("data").alias("m")).select("doc_id", "m.*").where("n > 0")


def saturated(freq: np.ndarray, length: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What a term's occurrences in a document of ``length`` terms count for."""
    if len(length) and 25 * int(length.max()) * docs > (1 << 62):
        share = np.array([25 * int(n) * docs // total for n in length], dtype=np.int64)
    else:
        share = 25 * length * docs // total
    return 1_000_000_000 * freq // (1000 * freq + 12 * (75 + share))


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _search_block(matches: DataFrame, held, k: int, tree_entries: int) -> DataFrame:
    """The k best (item, doc_id, score) of every task's documents."""
    def search(batches):
        block, weights, n_docs, total = held.value
        scale = np.sqrt(weights.astype(np.float64))
        size = len(weights)
        best: list[list] = [[] for _ in block]  # per item: (score, -doc_id or least for null, ...) as a heap

        def run(parts):
            length = np.concatenate([p[1] for p in parts])
            ptr = np.concatenate([[0], np.cumsum(np.concatenate([p[2] for p in parts]))])
            term, freq = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
            ids = np.concatenate([p[0] for p in parts])
            x = saturated(freq, np.repeat(length, np.diff(ptr)), n_docs, total)
            tree = BallTree(ptr, term, x * scale[term])
            for heap, (numbers, counts) in zip(best, block):
                exact, q = np.zeros(size, dtype=np.int64), np.zeros(size)
                exact[numbers] = counts * weights[numbers]
                q[numbers] = counts * scale[numbers]
                for rows in tree.leaves(q[:tree.width], lambda: heap[0][0] if len(heap) == k else 1):
                    at, of = tree.entries(rows)
                    score = np.add.reduceat(exact[term[at]] * x[at], np.flatnonzero(np.diff(of, prepend=-1)))
                    least = heap[0][0] if len(heap) == k else 1
                    for i in np.flatnonzero(score >= least):
                        one = (int(score[i]), -int(ids[rows[i]]))
                        if len(heap) < k:
                            heapq.heappush(heap, one)
                        elif one > heap[0]:
                            heapq.heapreplace(heap, one)

        parts, held_entries = [], 0
        for batch in batches:
            t = batch.column(2)
            n = np.diff(t.offsets.to_numpy())
            parts.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), n,
                          t.flatten().to_numpy(zero_copy_only=False), batch.column(3).flatten().to_numpy(zero_copy_only=False)))
            held_entries += len(parts[-1][3])
            if held_entries >= tree_entries:
                run(parts)
                parts, held_entries = [], 0
        if held_entries:
            run(parts)
        rows = [(i, -d, s) for i, heap in enumerate(best) for s, d in heap]
        cols = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],
                                         names=["item", "doc", "score"])

    # a null id takes the place after every other one
    least = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).alias("doc")
    return matches.where(F.size("terms") > 0).select(least, "n", "terms", "freqs").mapInArrow(search, "item long, doc long, score long")


def rank(docs: DataFrame, benchmark: DataFrame, k: int = 20, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
         block_terms: int = BLOCK_TERMS, tree_entries: int = TREE_ENTRIES) -> DataFrame:
    """For each item its ``k`` documents of highest score above 0: item_id, rank
    (from 1), doc_id, score; equal scores by ascending doc_id, a null id last.

    Null and empty texts have no terms: such a document isn't counted, such an
    item has no rows. Repeated documents are ranked each. Repeated benchmark rows
    count once; rows that share an id with different texts, or have none, are
    items of their own. An empty table gives no rows; other columns are not read.
    Ids are whole numbers.
    """
    spark = docs.sparkSession
    prepare(spark)
    own = docs.select(F.col(doc_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("data"))
    items = _items(benchmark, item_col, text_col, block_terms)
    blocks = items.agg(F.max("block")).first()[0]
    out = []
    for b in range(0 if blocks is None else blocks + 1):
        block = _Block(items.where(F.col("block") == b).collect())  # at most block_terms pairs and one item's
        if not block.ids:
            continue
        words = spark.sparkContext.broadcast(block.vocabulary)
        matches = Staged(spark).put(_matches(own, words))
        n_docs, total = matches.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(block.vocabulary), dtype=np.int64)
        for r in matches.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the block's vocabulary
            df[r["t"]] = r["count"]
        weights = np.array([weight(n_docs, int(x)) if n_docs else 0 for x in df], dtype=np.int64)
        held = spark.sparkContext.broadcast((block.items, weights, n_docs, total))
        found = _search_block(matches, held, k, tree_entries)
        ids = spark.createDataFrame([(i, x) for i, x in enumerate(block.ids)], "item long, item_id long")
        best = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
        out.append(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).join(F.broadcast(ids), "item")
                   .select("item_id", F.col("rank").cast("int").alias("rank"), F.nullif("doc", F.lit((1 << 63) - 1)).alias("doc_id"), "score"))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, out)
