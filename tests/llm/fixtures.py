"""Small tables with the awkward rows every operator must bear."""

import random

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names the operators use themselves
    T.StructField("score", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("_rid", T.StringType()),
    T.StructField("fp", T.StringType()), T.StructField("label", T.StringType()), T.StructField("_clean", T.StringType()),
    T.StructField("_at", T.StringType()), T.StructField("rid", T.StringType()), T.StructField("key", T.StringType()),
])


def prose(rng, n):
    return " ".join("".join(rng.choice(["ba", "ke", "lo", "mi", "nu", "ra", "to"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def awkward_rows(n=60, seed=5):
    """Plain rows, then: null id, null text, empty text, white space only, a
    very long text, an unbroken run, repeated rows, copies under other ids."""
    rng = random.Random(seed)
    rows = [(k, prose(rng, rng.randint(3, 120)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), None) for k in range(n)]
    long_text = prose(rng, 4000)
    rows += [(None, "no id here at all", "en", "a", 17), (None, None, None, None, None), (n + 1, None, "en", "a", 0), (n + 2, "", "en", "b", 0),
             (n + 3, " \t\n ", "en", "b", 4), (n + 4, long_text, "en", "a", len(long_text)), (n + 5, "x" * 5000, "en", "a", 5000),
             (n + 6, "é中文😀 ünï " * 40, "de", "b", 0)]
    rows += [(n + 7, "the same row twice " * 5, "en", "a", 1)] * 3
    rows += [(n + 10 + k, "a popular copy of many words that everyone repeats again and again", "en", "a", 1) for k in range(30)]
    return [(*r, "x", "x", "x", "x", "x", "x", "x", "x", "x") for r in rows]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
