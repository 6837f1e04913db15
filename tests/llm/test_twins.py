"""Plain-Python twins of what fitted models score, row by row; training bounds; raking that can't meet its targets."""

import math
import os
import struct
import sys

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fixtures import awkward, awkward_rows, prose  # noqa: E402
from ticketflow.llm import hnsw, mixing, quality, toxicity  # noqa: E402
from ticketflow.llm.common import sampled_texts, train_label_rows  # noqa: E402

SF = "/root/testdata/sf0.1"  # enough labels for each part of the sample


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 3 = 0").unionByName(
        awkward(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    return docs, spark.read.parquet(f"{SF}/labels.parquet")


def _texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_quality_scores_against_plain_python(spark, tables):
    docs, labels = tables
    model = quality.fit(docs, labels)
    assert len(model.rules) > 3

    def slow(text):
        stats = quality.statistics((text or "").encode())
        z = model.intercept + sum(w for r, w in zip(model.rules, model.weights) if all(low < stats[k] <= high for k, low, high in r.bounds))
        return 1 / (1 + math.exp(-z))

    want = sorted((repr(i), round(slow(t), 9)) for i, t in _texts(docs))
    got = quality.score(docs, model).collect()
    assert sorted((repr(r["doc_id"]), round(r["score"], 9)) for r in got) == want
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)


def _tree_value(node, x):
    while "Internal" in node.getClass().getSimpleName():
        split = node.split()
        node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
    return node.prediction()


def test_toxicity_scores_against_plain_python(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    trees = [(w, t._java_obj.rootNode()) for w, t in zip(model.trees.treeWeights, model.trees.trees)]
    edges, levels = np.array(model.calibration.boundaries), np.array(model.calibration.predictions)

    def slow(text):
        x = toxicity.features(text or "", model.lexicon)
        p = 1 / (1 + math.exp(-2 * sum(w * _tree_value(root, x) for w, root in trees)))
        return min(max(float(np.interp(p, edges, levels)), 0.0), 1.0)

    some = docs.where("doc_id is null or doc_id % 7 = 0 or doc_id > 10000 or doc_id < 100")
    got = toxicity.score(some, model).collect()
    assert sorted((repr(r["doc_id"]), round(r["score"], 7)) for r in got) == sorted((repr(i), round(slow(t), 7)) for i, t in _texts(some))
    assert len(got) > 400 and all(r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_training_bound_holds_for_repeated_ids(spark):
    docs = spark.createDataFrame([(1 if k < 300 else k, f"text {k}") for k in range(500)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, k % 2) for k in range(500)], "doc_id long, quality int")
    sample = train_label_rows(labels, "quality", "quality", 150).select("doc_id", "label")
    rows = sampled_texts(docs, sample, "doc_id", F.col("text")).collect()
    assert len(rows) <= 150 and sum(r["text"] in {f"text {k}" for k in range(300)} for r in rows) <= 1


def test_mix_against_plain_python(spark):
    df = awkward(spark)
    topics = mixing.fit_topics(df, "text")
    assert len({topics.of((r[1] or "").encode())[1] for r in awkward_rows()}) > 1
    got = mixing.mix(df, keep=0.5).collect()

    def uniform(doc_id, text):
        h = xxhash.xxh64_intdigest(struct.pack("<i", 42), seed=42)
        if doc_id is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=h)
        if text is not None:
            h = xxhash.xxh64_intdigest(text.encode(), seed=h)
        return (h >> 11) / 2.0 ** 53

    p = {(r["source"], r["lang"], r["topic"]): r["probability"] for r in got}
    want = []
    for i, text, lang, source, *_ in awkward_rows():
        n, topic = topics.of((text or "").encode())
        want.append((repr(i), topic, n + 1, uniform(i, text) < p[source, lang, topic]))
    assert sorted((repr(r["doc_id"]), r["topic"], r["n_tokens"], r["kept"]) for r in got) == sorted(want)


def test_topics_follow_the_words():
    import random
    rng = random.Random(1)
    vocabularies = [[prose(rng, 1) + str(k) for _ in range(40)] for k in range(3)]
    texts = [" ".join(rng.choice(vocabularies[k % 3]) for _ in range(60)) for k in range(90)]
    x = np.array([mixing.Topics.counts(t.encode().split()) for t in texts])
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0)))
    centres = np.stack([(x[k::3] * idf).sum(axis=0) for k in range(3)])
    topics = mixing.Topics(idf, centres / np.linalg.norm(centres, axis=1, keepdims=True))
    assert [topics.of(t.encode())[1] for t in texts] == [k % 3 for k in range(90)]
    assert topics.of(b"") == (0, 0)


def test_raking_says_what_it_misses(spark):
    """Cells that can't have the targets: raking ends, and says by how much."""
    cells = [("a", "en", 0, 100), ("b", "fr", 0, 100)]
    df = spark.createDataFrame(cells, "source string, lang string, topic int, mass long")
    margins = {"source": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "source string, share double"),
               "lang": spark.createDataFrame([("en", 0.2), ("fr", 0.8)], "lang string, share double")}
    for limit in (200_000, 0):
        got = mixing.rake_cells(df, margins, 0.5, limit).collect()
        assert len(got) == 2 and all(r["miss"] > 0.3 for r in got)


def test_slow_raking_goes_on(monkeypatch):
    """Targets met only after far more than the sweeps that end hopeless cases."""
    rng = np.random.default_rng(0)
    n = 40
    mass = np.concatenate([rng.integers(1, 5, n) * 1e6, np.ones(n)])  # two almost separate parts, joined by light cells
    rows, cols = np.concatenate([np.arange(n), np.arange(n)]), np.concatenate([np.arange(n), (np.arange(n) + 1) % n])
    target = mass * rng.uniform(0.5, 2, 2 * n)
    targets = [np.bincount(rows, weights=target, minlength=n) / target.sum(), np.bincount(cols, weights=target, minlength=n) / target.sum()]
    _, miss = mixing._rake_numpy(mass, [rows, cols], targets)
    assert miss < 1e-4


# ---------------------------------------------------------------- graph search at size

def _recall(x, shard_rows, spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got: dict = {}
    for r in hnsw.search(df, shard_rows=shard_rows).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    u = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    hits = 0
    for q in range(0, len(x), 50):
        s = u @ u[q]
        s[q] = -9
        kth = np.sort(s)[-5]
        hits += sum(s[i] >= kth - 1e-12 for i in got[q])
    return hits / (5 * len(range(0, len(x), 50)))


def test_recall_over_several_full_shards(spark):
    rng = np.random.default_rng(1)
    assert _recall(rng.normal(size=(6000, 48)), 1500, spark) >= 0.9
    centres = rng.normal(size=(40, 48)) * 3
    assert _recall(centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 48)) * 0.1, 3000, spark) >= 0.9


def test_parallel_and_extreme_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1200, 16))
    x[400:800] = x[0] * rng.uniform(0.1, 10, size=(400, 1))  # copies of one direction at other lengths
    x[800:900] *= 1e200
    x[900:1000] *= 1e-200
    assert _recall(x, 1200, spark) >= 0.9
    g = hnsw.build(x)
    assert all(hnsw._reached(t, g.entry)[g.levels >= level].all() for level, t in enumerate(g.links))
