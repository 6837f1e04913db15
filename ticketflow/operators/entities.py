"""Who, where and what a message names, and a learned category."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow.operators.search import tokens
from ticketflow.session import cut_lineage, stage, unstage

FEATURES = 1 << 16
ROUNDS = 30  # of a category model's fit, at most


def _named(messages: DataFrame, dictionaries: dict[str, DataFrame], id_col: str, text_col: str) -> DataFrame:
    """(id, a column per dictionary): the name of each dictionary (name) that a
    message holds, of messages that hold any; one row per id.

    The messages are split into tokens and n-grams once for all dictionaries. An
    n-gram is joined with the names that read so, once however often it stands in a
    message; the best match of a dictionary is a minimum per message.
    """
    every = reduce(lambda a, b: a.unionByName(b), [d.select(F.lit(c).alias("of"), "name") for c, d in dictionaries.items()])
    least = (every.select("of", "name", tokens("name").alias("t")).where(F.size("t") > 0)
             .groupBy("of", F.array_join("t", " ").alias("gram"), F.size("t").alias("n")).agg(F.min("name").alias("name")))
    # one row per n-gram, with its name in each dictionary
    dictionary = cut_lineage(least.groupBy("gram", "n").agg(*[F.min(F.when(F.col("of") == c, F.col("name"))).alias(c) for c in dictionaries]))
    lengths = sorted(r[0] for r in dictionary.select("n").distinct().collect())  # the few token counts that names have
    words = messages.select(F.col(id_col).alias("id"), tokens(text_col).alias("t"))
    none = F.array().cast("array<struct<n:int,at:int,gram:string>>")

    def grams(n: int):
        """The n-grams of a message's tokens, with their places."""
        made = F.transform(F.sequence(F.lit(1), F.size("t") - F.lit(n - 1)), lambda i: F.struct(
            F.lit(n).alias("n"), i.alias("at"), F.array_join(F.slice("t", i, n), " ").alias("gram")))
        return F.when(F.size("t") >= n, made).otherwise(none)

    met = words.select("id", F.inline(F.concat(none, *[grams(n) for n in lengths]))).join(dictionary, ["n", "gram"])
    best = [F.min(F.when(F.col(c).isNotNull(), F.struct((-F.col("n")).alias("n"), "at", F.col(c).alias("name")))).alias(c) for c in dictionaries]
    return met.groupBy(F.struct("id").alias("k")).agg(*best).select(F.col("k.id").alias("id"), *[F.col(f"{c}.name").alias(c) for c in dictionaries])


def find_names(messages: DataFrame, names: DataFrame, id_col: str, text_col: str, name_col: str = "name") -> DataFrame:
    """(id, name): for each message the name of the dictionary that it holds, or null.

    Messages and names are split into the same word tokens; a name matches where
    its tokens stand in a row. The longest match wins (in tokens), then the first
    one, then the least name. The match is an equi-join of the messages' token
    n-grams, of the lengths that names have, with the dictionary.
    """
    best = _named(messages, {"name": names.select(F.col(name_col).alias("name"))}, id_col, text_col)
    return messages.select(F.col(id_col).alias("id")).join(best, "id", "left").select(F.col("id").alias(id_col), "name")


def extract_people_and_places(messages: DataFrame, employees: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Reporter, department and location that a message names, each null where
    it names none; a department or location it doesn't name is the reporter's own.
    Messages without an id give no row."""
    sources = {"reporter_name": "employee_name", "department": "department", "location": "location"}
    names = {c: employees.select(F.col(s).alias("name")).where(F.col("name").isNotNull()).distinct() for c, s in sources.items()}
    best = _named(messages.where(F.col(id_col).isNotNull()), names, id_col, text_col)
    # an id of n messages gives each of them once per message and kind of name
    ids = messages.where(F.col(id_col).isNotNull()).groupBy(F.struct(F.col(id_col).alias("id")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    times = F.col("n") * F.col("n") * F.col("n") * F.col("n")
    found = ids.select(F.col("k.id").alias("id"), F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("_")).drop("_").join(best, "id", "left")
    own = (employees.groupBy(F.struct("employee_name").alias("k")).agg(F.min(F.struct("employee_id", "department", "location")).alias("e"))
           .select(F.col("k.employee_name").alias("reporter_name"), F.col("e.department").alias("_department"), F.col("e.location").alias("_location")))
    return found.join(own, "reporter_name", "left").select(
        F.col("id").alias(id_col), "reporter_name", F.coalesce("department", "_department").alias("department"), F.coalesce("location", "_location").alias("location"))


def _last_of_least(ids: DataFrame, rows: int):
    """The last (h, id) of the ``rows`` least different ones; None where no more
    than these are there. Hashes are even over their range, so all but about twice
    as many rows are left aside by a bound on the hash before anything is sorted;
    a bound that leaves too few is dropped."""
    ids = cut_lineage(ids.distinct())
    n = ids.count()
    if n <= rows:
        return None
    bound = int(min(1.0, (2.0 * rows + 100) / n) * (1 << 64)) - (1 << 63)
    some = ids.where(F.col("h") < F.lit(bound)) if bound < (1 << 63) else ids
    if some.count() < rows:
        some = ids
    return some.orderBy("h", "id").limit(rows).orderBy(F.desc("h"), F.desc("id")).first()


def learn_category(labelled: DataFrame, id_col: str, text_col: str, label_col: str):
    """A function that adds ``predicted`` to messages: TF-IDF over word tokens and
    multinomial logistic regression.

    Fitted on every row with a text and a label; one row per id, that of the least
    label and text. The texts are read once: their hashed word counts are staged,
    and every pass of the fit reads these.
    """
    usable = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.struct(F.col(label_col).alias("y"), F.col(text_col).alias("x")).alias("r"))
    rows = usable.groupBy("id").agg(F.min("r").alias("r")).select("r.y", tokens("r.x").alias("words"))
    hashing = HashingTF(inputCol="words", outputCol="counts", numFeatures=FEATURES)
    counted = stage(hashing.transform(rows).select("y", F.size(F.array_distinct("words")).alias("n"), "counts"))
    try:
        sizes = counted.groupBy("y").agg(F.sum("n").alias("n")).orderBy("y").collect()
        classes = [r["y"] for r in sizes]
        if not classes:
            raise ValueError("no labelled rows to learn from")
        number = F.element_at(F.create_map(*[x for k, c in enumerate(classes) for x in (F.lit(c), F.lit(float(k)))]), F.col("y"))
        # every pass sends a gradient of all classes and features per task: a task holds
        # as many bytes of counts (12 a word) as its gradients of all passes have, 1 GB at most
        held = min(ROUNDS * len(classes) * FEATURES * 8, 1 << 30)
        learned = counted.coalesce(max(1, -(-sum(r["n"] for r in sizes) * 12 // held)))
        model = Pipeline(stages=[IDF(inputCol="counts", outputCol="weights"),
                                 LogisticRegression(featuresCol="weights", labelCol="label", family="multinomial", regParam=1e-3, maxIter=ROUNDS)]).fit(
            learned.select("counts", number.alias("label")))
    finally:
        unstage(counted)

    def predict(messages: DataFrame) -> DataFrame:
        scored = model.transform(hashing.transform(messages.withColumn("words", tokens(text_col))))
        label = F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("prediction").cast("int") + 1)
        return scored.select(*messages.columns, label.alias("predicted"))

    return predict
