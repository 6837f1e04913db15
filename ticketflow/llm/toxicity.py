"""Toxicity scores: gradient-boosted trees over dense features, calibrated by
isotonic regression.

The lexicon holds words, and beginnings of words, that stand out in toxic texts
of the labelled sample. Trees must not learn from rows their lexicon was taken
from: of two halves, each gets its features from the other half's lexicon. The
final lexicon comes from both; a further part of the sample, which neither the
lexicon nor the trees have seen, fits the calibration.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ticketflow.session import cut_lineage
from .common import held_out, parts_for, prepare, sampled_texts, text_bytes, train_label_rows

# Labelled rows the model is fitted on, at most (those of smallest id hash).
MAX_TRAIN_ROWS = 12_000
LEXICON_TERMS = 400     # terms kept, those of largest likelihood ratio
MIN_DOCS, MIN_LOG_ODDS = 3, 2.0
MIN_RATIO = 7.5         # log likelihood ratio: chance terms of a small sample stay below
PREFIXES = (4, 5, 6, 7)
NEAR = 6                # words within which a second person counts as near
TREES, DEPTH = 30, 3
ROWS_PER_TASK = 1_000   # training rows: every level of every tree is a job with a shuffle, whose files follow its tasks
THRESHOLD = 0.3

# Second-person words of the four languages (fixed values).
SECOND_PERSON = frozenset(
    "you your yours yourself ya u du dich dir dein deine deinen deiner ihr euch euer eure sie "
    "tu te toi ton ta tes vous votre vos tú ti usted ustedes tus vosotros".split())
# Characters that stand for letters in disguised words (fixed values).
LEET = str.maketrans("013457@$!|", "oieastasil")

FEATURES = ["word_density", "word_hits", "word_weight", "prefix_density", "prefix_hits", "prefix_weight", "disguised_hits",
            "disguised_rate", "second_person", "hits_near_second_person", "densest_window", "strongest_word", "strongest_prefix", "capitals", "shouted_words",
            "exclamations", "punctuation", "log_words"]
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "@$") + "«»„“”‘’…¿¡"
_PLAIN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?\Z")


def plain_words(text: str) -> tuple[list[str], set[int], int]:
    """(words in lower case with disguises undone, positions of those that were
    disguised, words in capitals). A word is what stands between white space, without
    punctuation at its ends."""
    out, disguised, shouted = [], set(), 0
    for raw in text.split():
        w = raw.strip(_EDGE)
        if not w:
            continue
        if len(w) > 2 and w.isupper():
            shouted += 1
        w = w.lower()
        if not _PLAIN.match(w) and any(c.isalpha() for c in w):
            plain = "".join(c for c in w.translate(LEET) if c.isalpha())
            if plain != w and len(plain) > 2:
                disguised.add(len(out))
                w = plain
        out.append(w)
    return out, disguised, shouted


def terms_of(words: list[str]) -> set[str]:
    """Different words, and beginnings (marked with ~) of longer ones."""
    ws = set(words)
    return ws | {w[:n] + "~" for w in ws for n in PREFIXES if len(w) > n}


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """The features of a text, in the order of FEATURES. A word's beginning
    counts with the weight of its strongest prefix."""
    words, disguised, shouted = plain_words(text)
    n = max(1, len(words))
    at, w_sum, w_top, prefix_hits, p_sum, p_top = [], 0.0, 0.0, 0, 0.0, 0.0
    for k, w in enumerate(words):
        s = lexicon.get(w, 0.0)
        p = max([lexicon.get(w[:m] + "~", 0.0) for m in PREFIXES if len(w) > m], default=0.0)
        if s or p:
            at.append(k)
            w_sum, w_top = w_sum + s, max(w_top, s)
            if not s:
                prefix_hits += 1
            p_sum, p_top = p_sum + p, max(p_top, p)
    you = [k for k, w in enumerate(words) if w in SECOND_PERSON]
    pos, person = np.array(at, dtype=np.int64), np.array(you, dtype=np.int64)
    near = 0
    if len(pos) and len(person):
        j = np.searchsorted(person, pos)
        left = np.abs(pos - person[np.maximum(j - 1, 0)])
        right = np.abs(person[np.minimum(j, len(person) - 1)] - pos)
        near = int((np.minimum(left, right) <= NEAR).sum())
    densest = int((np.searchsorted(pos, pos + 50) - np.arange(len(pos))).max()) if len(pos) else 0
    c = max(1, len(text))
    word_hits = len(at) - prefix_hits
    return [word_hits / n, float(np.log1p(word_hits)), w_sum / n, prefix_hits / n, float(np.log1p(prefix_hits)), p_sum / n,
            float(sum(k in disguised for k in at)), len(disguised) / n, len(you) / n, near / max(1, len(at)), float(densest), w_top, p_top,
            sum(map(str.isupper, text)) / c if not text.islower() else 0.0, shouted / n, text.count("!") / c,
            sum(text.count(x) for x in ".,;:?*#") / c, float(np.log1p(len(words)))]


def learn_lexicon(rows: DataFrame, size: int = LEXICON_TERMS) -> dict[str, float]:
    """term -> log odds of the terms that stand out in toxic texts; rows has
    label and text. Counts are documents; equal texts count once."""
    def tally(batches):
        for pdf in batches:
            both: dict[str, list[int]] = {}
            for label, text in zip(pdf["label"], pdf["text"]):
                for t in terms_of(plain_words(text)[0]):
                    both.setdefault(t, [0, 0])[label] += 1
            yield pd.DataFrame([(t, a, b) for t, (a, b) in both.items()], columns=["term", "neg", "pos"])

    unique = cut_lineage(rows.groupBy("text").agg(F.max("label").alias("label")))
    n, p = unique.agg(F.coalesce(F.sum(1 - F.col("label")), F.lit(0)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n or not p:
        return {}
    a, b = F.col("pos"), F.col("neg")
    odds = F.log((a + 0.5) / (p + 1.0)) - F.log((b + 0.5) / (n + 1.0))
    share = (a + b) / F.lit(float(n + p))
    ratio = a * F.log(a / (share * p)) + F.when(b > 0, b * F.log(b / (share * n))).otherwise(0.0)
    best = (unique.mapInPandas(tally, "term string, neg long, pos long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            .where(a >= MIN_DOCS).withColumn("odds", odds).where(F.col("odds") >= MIN_LOG_ODDS)
            .withColumn("ratio", ratio).where(F.col("ratio") >= MIN_RATIO).orderBy(F.desc("ratio"), "term").limit(size).collect())
    return {r["term"]: float(r["odds"]) for r in best}


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    prior: float

    def features(self, text: Column) -> Column:
        lexicon = self.lexicon

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def of(s: pd.Series) -> pd.Series:
            return pd.Series([features(x, lexicon) for x in s])
        return of.asNondeterministic()(text)

    def raw(self, rows: DataFrame) -> DataFrame:
        """rows (with an array column f) and the trees' probability, column p."""
        out = self.trees.transform(rows.withColumn("features", array_to_vector("f")))
        return out.withColumn("p", F.get(vector_to_array("probability"), F.lit(1))).drop("features", "rawPrediction", "probability", "prediction")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        max_rows: int = MAX_TRAIN_ROWS) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled rows, held-out ids left aside.
    Documents that share an id count once. Without rows of both labels in a part, the score is the smoothed share of
    label 1."""
    prepare(docs.sparkSession)
    sample = train_label_rows(labels, label, "toxic", max_rows)
    # the sample's texts, bounded by max_rows documents, are read once
    rows = cut_lineage(sampled_texts(docs, sample, id_col, F.coalesce(F.col(text_col), F.lit(""))).select("label", "part", "text"))
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    model = ToxicityModel({}, None, None, (positive + 1) / (n + 2))
    halves = [(F.col("part") < 4), F.col("part").between(4, 7)]
    label = F.col("label").cast("double").alias("label")
    train = None
    for own, other in (halves, halves[::-1]):
        model.lexicon = learn_lexicon(rows.where(other).select("label", "text"))
        part = rows.where(own).select(label, model.features(F.col("text")).alias("f"))
        train = part if train is None else train.union(part)
    # the few rows may lie in as many partitions as the session shuffles into
    train = cut_lineage(train).coalesce(parts_for(docs.sparkSession, n, ROWS_PER_TASK))
    model.lexicon = learn_lexicon(rows.where("part < 8").select("label", "text"))
    held = cut_lineage(rows.where("part >= 8").select(label, model.features(F.col("text")).alias("f")))
    if any(df.select("label").distinct().count() < 2 for df in (train, held)):
        return model
    model.trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, subsamplingRate=0.8, seed=42).fit(
        train.select("label", array_to_vector("f").alias("features")))
    # rows of one probability count once, with their share of label 1 and their number
    levels = model.raw(held).groupBy("p").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("n"))
    model.calibration = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="n").fit(cut_lineage(levels))
    return model


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out (crc32 of the id as text, modulo 4, is
    2), score (0 to 1), predicted (1 from 0.3 on).

    Null and empty texts get the score of an empty text's features. A null id is
    not held out. Repeated rows each give a row, an empty table none; the label,
    the language, the source and the id do not enter the score.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    if model.trees is None:
        out = rows.select("_id", F.lit(model.prior).alias("score"))
    else:
        out = model.raw(rows.select("_id", model.features(F.col("_t")).alias("f")).select("_id", "f"))
        out = model.calibration.transform(out.select("_id", "p")).select("_id", F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)).alias("score"))
    return out.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
