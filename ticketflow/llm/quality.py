"""Quality scores by a sparse rule ensemble.

Documents become statistics of their text. A random forest over labelled rows
proposes rules: the path to each of its nodes is a conjunction of bounds on
statistics. A lasso logistic regression weighs the rules and leaves few of
them, which are compiled into one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ticketflow.session import cut_lineage
from .common import fresh, held_out, prepare, sampled_texts, text_bytes, train_label_rows

# Labelled rows the model is fitted on, at most (those of smallest id hash).
MAX_TRAIN_ROWS = 20_000
TREES, DEPTH, LASSO = 16, 3, 0.002
THRESHOLD = 0.7

STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "longest_word", "upper_share", "digit_share", "stop_share", "punct_share",
    "symbol_share", "non_ascii_share", "unique_words", "unique_triples", "top_word_share", "repeated_lines",
    "words_per_line", "closed_lines", "symbol_words", "short_words",
]
_PUNCT = np.frombuffer(b",;:'\"()-", dtype=np.uint8)
_STOP = np.frombuffer(b".!?", dtype=np.uint8)
_SYMBOL = np.array([c for c in range(33, 127) if not chr(c).isalnum() and c not in b",;:'\"()-.!?"], dtype=np.uint8)
_MARK = bytes(1 if c in bytes(_SYMBOL) else 0 for c in range(256))


def statistics(data: bytes) -> list[float]:
    """The statistics of a text's UTF-8 bytes, in the order of STATISTICS; all
    finite, also for an empty text."""
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    n = max(1, len(data))
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    words = data.split()
    k = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    triples = len(set(zip(words, words[1:], words[2:])))
    lines = [x for x in data.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    symbols = data.translate(_MARK).count(1) and sum(1 for w in words if any(w.translate(_MARK)))
    return [
        float(np.log1p(len(data))), float(np.log1p(len(words))), float(lengths.sum() / k), float(np.log1p(lengths.max(initial=0))),
        upper / max(1, upper + lower), int(counts[48:58].sum()) / n, int(counts[_STOP].sum()) / n, int(counts[_PUNCT].sum()) / n,
        int(counts[_SYMBOL].sum()) / n, int(counts[128:].sum()) / n, len(tally) / k, triples / max(1, len(words) - 2),
        max(tally.values(), default=0) / k, 1 - len(set(lines)) / m, len(words) / m,
        sum(x.rstrip().endswith((b".", b"!", b"?", b"\xe2\x80\xa6")) for x in lines) / m, symbols / k, int((lengths <= 3).sum()) / k,
    ]


def statistics_column(data: Column) -> Column:
    """array<double> of the statistics of a binary column."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def of(s: pd.Series) -> pd.Series:
        return pd.Series([statistics(bytes(x)) for x in s])
    return of.asNondeterministic()(data)


@dataclass(frozen=True)
class Rule:
    """Bounds low < statistic <= high per statistic."""
    bounds: tuple[tuple[int, float, float], ...]

    def column(self, stats: Column) -> Column:
        out = F.lit(True)
        for k, low, high in self.bounds:
            if low > float("-inf"):
                out = out & (F.get(stats, F.lit(k)) > low)
            if high < float("inf"):
                out = out & (F.get(stats, F.lit(k)) <= high)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{low:.4g} < {STATISTICS[k]} <= {high:.4g}" for k, low, high in self.bounds)


def tree_rules(tree) -> set[Rule]:
    """The rule of each node but the root of a fitted tree."""
    out: set[Rule] = set()

    def walk(node, bounds: dict) -> None:
        if bounds:
            out.add(Rule(tuple((k, *b) for k, b in sorted(bounds.items()))))
        if "Internal" not in node.getClass().getSimpleName():
            return
        k, cut = node.split().featureIndex(), node.split().threshold()
        low, high = bounds.get(k, (float("-inf"), float("inf")))
        walk(node.leftChild(), bounds | {k: (low, min(high, cut))})
        walk(node.rightChild(), bounds | {k: (max(low, cut), high)})

    walk(tree._java_obj.rootNode(), {})
    return out


@dataclass
class RuleModel:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def score(self, stats: Column) -> Column:
        """Probability of label 1, as a column expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights):
            total = total + F.when(rule.column(stats), F.lit(w)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _prior(positive: int, n: int) -> float:
    return float(np.log((positive + 1) / (n - positive + 1)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        max_rows: int = MAX_TRAIN_ROWS) -> RuleModel:
    """Fit on at most ``max_rows`` labelled rows, held-out ids left aside.
    Documents that share an id count once. Without rows of both labels the model is the smoothed share of label 1."""
    prepare(docs.sparkSession)
    sample = train_label_rows(labels, label, "quality", max_rows).select("doc_id", "label")
    rows = cut_lineage(sampled_texts(docs, sample, id_col, text_bytes(text_col)).select("label", statistics_column(F.col("text")).alias("stats")))
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if positive in (0, n):
        return RuleModel([], [], _prior(positive, n))
    train = rows.select(F.col("label").cast("double").alias("label"), "stats", array_to_vector("stats").alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, subsamplingRate=0.7,
                                    featureSubsetStrategy="onethird", seed=42).fit(train)
    rules = sorted({r for t in forest.trees for r in tree_rules(t)}, key=lambda r: r.bounds)
    if not rules:
        return RuleModel([], [], _prior(positive, n))
    hits = cut_lineage(train.select("label", F.array(*[F.when(r.column(F.col("stats")), 1.0).otherwise(0.0) for r in rules]).alias("hit")))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60).fit(
        hits.select("label", array_to_vector("hit").alias("features")))
    kept = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if abs(w) > 1e-9]
    return RuleModel([r for r, _ in kept], [w for _, w in kept], float(lasso.intercept))


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out (crc32 of the id as text, modulo 4, is
    2), score (0 to 1), predicted (1 from 0.7 on).

    Null and empty texts get the score of an empty text's statistics. A null id
    is not held out. Repeated rows each give a row, an empty table none; the
    label, the language, the source and the id do not enter the score.
    """
    prepare(docs.sparkSession)
    out = (docs.select(F.col(id_col), text_bytes(text_col).alias("_t"))
           .select(F.col(id_col), statistics_column(F.col("_t")).alias("_s")).select(F.col(id_col), model.score(F.col("_s")).alias("score")))
    return out.select(F.col(id_col), held_out(id_col).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """The documents predicted 1, with all their columns."""
    s = fresh(docs, "_stats")
    return (docs.withColumn(s, statistics_column(text_bytes(text_col))).where(model.score(F.col(s)) >= THRESHOLD)
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
