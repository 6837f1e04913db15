"""The learned category is fitted on every labelled row, whatever their number, with every category."""

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ticketflow.operators import entities
from ticketflow.session import checkpoint_dir


def _staged(spark):
    return [x for x in os.listdir(checkpoint_dir(spark).removeprefix("file:")) if x.startswith("stage-")]


def test_learns_from_every_labelled_row(spark):
    """Rows beyond the 20,000 of the least hash of the id carry a category of their own."""
    ids = spark.range(21_000).select("id", F.row_number().over(Window.orderBy(F.xxhash64("id"), "id")).alias("place"))
    labelled = ids.select("id", F.when(F.col("place") > 20_500, "C").when(F.col("id") % 2 == 0, "A").otherwise("B").alias("category"))
    word = F.when(F.col("category") == "C", "gamma").when(F.col("category") == "A", "alpha").otherwise("beta")
    before = _staged(spark)
    predict = entities.learn_category(labelled.withColumn("text", word), "id", "text", "category")
    assert _staged(spark) == before  # its tables are deleted
    messages = spark.createDataFrame([(1, "Gamma!"), (2, "an alpha"), (3, "beta")], "id long, text string")
    assert {r.id: r.predicted for r in predict(messages).collect()} == {1: "C", 2: "A", 3: "B"}


def test_learns_more_than_a_thousand_categories(spark, monkeypatch):
    monkeypatch.setattr(entities, "FEATURES", 512)
    rows = spark.range(1_050).select("id", F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("category"))
    rows = rows.withColumn("text", F.concat_ws(" ", F.lit("w"), F.concat(F.lit("x"), (F.col("id") % 35).cast("string")), F.concat(F.lit("y"), F.floor(F.col("id") / 35).cast("string"))))
    found = entities.learn_category(rows, "id", "text", "category")(rows).where("id >= 1000").collect()
    assert len(found) == 50 and sum(r.predicted == r.category for r in found) >= 45


def test_an_id_counts_once(spark):
    """Of an id's rows the one of the least label and text; rows without a label or text are no examples."""
    rows = [(k, c, t) for k, (c, t) in enumerate([("A", "alpha"), ("B", "beta")] * 10)]
    rows += [(k, "Z", "alpha") for k in range(0, 20, 2) for _ in range(30)] + [(100, None, "alpha"), (101, "Y", None)]
    labelled = spark.createDataFrame(rows, "id long, category string, text string")
    got = entities.learn_category(labelled, "id", "text", "category")(spark.createDataFrame([("alpha",), ("beta",), (None,)], "text string"))
    assert [r.predicted for r in got.collect()][:2] == ["A", "B"]
    assert {r.predicted for r in got.collect()} <= {"A", "B"}


def test_nothing_to_learn_from(spark):
    before = _staged(spark)
    with pytest.raises(ValueError, match="no labelled rows"):
        entities.learn_category(spark.createDataFrame([(1, None, "a"), (2, "A", None)], "id long, category string, text string"), "id", "text", "category")
    assert _staged(spark) == before
