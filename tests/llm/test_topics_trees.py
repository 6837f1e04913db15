"""Topics from every text; boosted trees on few tasks."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ticketflow.llm import mixing, toxicity


def test_topics_are_fitted_on_every_text(spark):
    """A word of one text among 3,000 counts, and copies count once."""
    rows = [(k, f"w{k % 7} w{k % 11} n{k}") for k in range(3_000)]
    words: dict = {}
    for _, t in rows:
        for at in np.flatnonzero(mixing.Topics.counts(t.encode().split())):
            words[at] = words.get(at, 0) + 1
    want = np.log(3_001 / (1 + np.array([words.get(k, 0) for k in range(mixing.DIMS)])))
    df = spark.createDataFrame(rows + rows[:500] + [(-1, None), (-2, " ")], "doc_id long, text string")
    one, other = (mixing.fit_topics(df.repartition(n), "text") for n in (2, 5))
    assert np.allclose(one.idf, want) and len(one.centres) == mixing.TOPICS
    assert np.array_equal(one.centres, other.centres)  # the same in any order of the rows


def test_packed_counts_come_back():
    counts = mixing.Topics.counts(b"a b b c".split())
    assert np.array_equal(mixing._unpacked(mixing._packed(counts)), counts) and not mixing._unpacked(b"").any()


def test_trees_learn_on_few_tasks(spark, monkeypatch):
    """Every level of every tree shuffles: its tasks follow the rows, not the session's partitions."""
    seen = []
    fit = toxicity.GBTClassifier.fit
    monkeypatch.setattr(toxicity.GBTClassifier, "fit", lambda self, df: (seen.append(df.rdd.getNumPartitions()), fit(self, df))[1])
    docs = spark.createDataFrame([(k, f"vile you scum {k}" if k % 2 else f"a good day {k}") for k in range(400)], "doc_id long, text string").repartition(40)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    monkeypatch.setattr(toxicity, "TREES", 1)
    monkeypatch.setattr(toxicity, "cut_lineage", lambda df: df.repartition(50).checkpoint())
    toxicity.fit(docs, labels)
    assert seen and seen[0] <= max(4, spark.sparkContext.defaultParallelism)


def test_texts_are_cut_into_words_once(spark, monkeypatch):
    """The rows of mix come from what the topics were fitted on; rounds read nothing but vectors."""
    seen = []
    frame = type(spark.range(0))
    run = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **b: (seen.append(self.columns), run(self, *a, **b))[1])
    rows = [(k, f"w{k % 7} w{k % 11} n{k}", "en", f"s{k % 3}") for k in range(300)] + [(None, None, None, None), (1, "", "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "text" not in plan
    assert seen[:2] == [mixing.PACKED, ["h", "s", *mixing.PACKED]] and len(seen) > 2 and all(c == mixing.PACKED for c in seen[2:])
    assert out.columns[0] == "doc_id" and sorted((repr(r[0]), r[4]) for r in out.collect()) == sorted((repr(i), len((t or "").split()) + 1) for i, t, *_ in rows)


def test_packed_counts_are_small():
    """Few different counts stand at many places; several vectors are read at once."""
    counts = [mixing.Topics.counts(t.split()) for t in (b" ".join(b"w%d" % (k % 300) for k in range(500)), b"a", b"", b"b b c " * 9)]
    packed = [mixing._packed(c) for c in counts]
    assert sum(map(len, packed[0])) < 5 * np.count_nonzero(counts[0]) and packed[2] == (b"", b"", b"")
    columns = [pa.array([b"left out", *c], pa.binary()).slice(1) for c in zip(*packed)]
    row, at, value = mixing._entries(*columns)
    x = np.zeros((4, mixing.DIMS))
    x[row, at] = value
    assert np.array_equal(x, counts) and np.bincount(row, minlength=4).tolist() == [np.count_nonzero(c) for c in counts]
