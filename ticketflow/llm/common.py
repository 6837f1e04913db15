"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from ticketflow.session import checkpoint_dir, cut_lineage, ship_package

# Texts reach Python in Arrow batches of at most this many rows, so that one
# batch of long documents stays far below a worker's memory.
ROWS_PER_BATCH = 256


def prepare(spark: SparkSession) -> None:
    """Ship the package to Python workers and bound their Arrow batches."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has (case ignored)."""
    taken = {c.lower() for c in df.columns}
    name, n = base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def text_bytes(col: str | Column) -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.lit("")).cast("binary")


class Staged:
    """The frame of a loop's last round, as a Parquet table in the shared
    checkpoint folder. A checkpoint keeps the size estimate of its plan, which
    squares with each round's self-join; a table has its true size. ``put``
    deletes the round before; the last round's files stay for the caller."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, f"{checkpoint_dir(spark).rstrip('/')}/rounds-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.base}/{self.n + 1}")
        if self.n:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{self.n}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.n += 1
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{self.n}")


def _is_plain_scan(df: DataFrame) -> bool:
    """Whether each row of ``df`` is a row of a file that is read once: nothing
    but projections and filters over one scan. An explode, a join or a union
    above the scan gives several rows the same file and row number."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    roots = plan.relation().location().rootPaths()
    paths = sorted(roots.apply(k).toString().rstrip("/") + "/" for k in range(roots.size()))
    return not any(b.startswith(a) for a, b in zip(paths, paths[1:]))


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column that identifies each row, equal in every job that
    reads ``df`` again.

    Over a plain Parquet scan it is (hash of the file's path, row number in the
    file), so nothing is stored. Any other frame is checkpointed with a
    generated number.
    """
    if _is_plain_scan(df):
        try:
            return df.withColumn(name, F.struct(
                F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
        except AnalysisException:  # a format without row numbers
            pass
    return cut_lineage(df.withColumn(name, F.struct(
        F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))))


def train_label_rows(labels: DataFrame, label: str, salt: str, max_rows: int) -> DataFrame:
    """(doc_id, label, part) of at most ``max_rows`` labelled rows for training.

    Rows whose crc32(doc_id as text) mod 4 is 2 are held out. A doc_id that
    has several labels counts once when they agree and not at all when they
    differ; null ids and labels other than 0 and 1 take no part. The sample is
    the rows of smallest hash. ``part`` (0 to 9) is a second hash that splits
    the sample for fitting and calibration.
    """
    one = (labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
           .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
           .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
           .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_hi"))
           .where(F.col("label") == F.col("_hi")).drop("_hi"))
    h = F.xxhash64(F.lit(salt), F.col("doc_id"))
    return (one.withColumn("_h", h).orderBy("_h", "doc_id").limit(max_rows)
            .select("doc_id", "label", F.pmod(F.xxhash64(F.lit(salt + "/part"), F.col("doc_id")), F.lit(10)).cast("int").alias("part")))


def sampled_texts(docs: DataFrame, sample: DataFrame, id_col: str, text: Column) -> DataFrame:
    """The sample's rows (doc_id, ...) with a column ``text``. An id that several
    documents have gives one row, that of the least text by hash, so the sample's
    bound holds for the texts too."""
    rest = [c for c in sample.columns if c != "doc_id"]
    return (docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id")
            .agg(F.min_by(F.struct("text", *rest), F.struct(F.xxhash64("text"), "text")).alias("_r")).select("_r.*"))


def held_out(col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def parts_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Tasks for ``rows`` rows, at least one per core of the cluster."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / per_task))
