"""Skew-safe building blocks.

``row_number().over(Window.partitionBy(k).orderBy(...))`` sends every row of
a key to one task; one thread or one global order (no key at all) holding a
third of the data then runs in a single task. ``sequence_within`` computes
the same 1-based position without that bottleneck:

1. range-partition on (keys, order): the sampled bounds split a hot key
   over many partitions, each then sorted locally;
2. ``monotonically_increasing_id`` gives each row its local position;
3. a small table of (partition, key) -> first id, row count is aggregated,
   and a window over it (at most one row per partition per key) yields how
   many rows of the key precede the partition;
4. rows join back to that table on (partition, key).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketflow.session import cut_lineage


def _order_cols(order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def sequence_within(df: DataFrame, keys: list[str], order: list, name: str = "rn",
                    partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of each row within its key by ``order``.

    ``order`` must make the order total (end with a unique column) for a
    deterministic result. ``keys`` may be empty for a global sequence.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ocols = _order_cols(order)
    kcols = [F.col(k) for k in keys]
    staged = (df.repartitionByRange(n, *kcols, *ocols)
              .sortWithinPartitions(*kcols, *ocols)
              .withColumn("_seq_pid", F.spark_partition_id())
              .withColumn("_seq_mid", F.monotonically_increasing_id()))
    # Each planned copy of a range exchange samples its own bounds, so the two
    # consumers below must read one materialization: a reliable checkpoint in
    # the shared checkpoint folder (also cuts lineage; survives executor loss).
    staged = cut_lineage(staged)
    per_part = staged.groupBy("_seq_pid", *keys).agg(
        F.min("_seq_mid").alias("_seq_first"), F.count(F.lit(1)).alias("_seq_n"))
    before = Window.partitionBy(*keys).orderBy("_seq_pid").rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.withColumn("_seq_before", F.coalesce(F.sum("_seq_n").over(before), F.lit(0)))
    p = per_part.alias("_p")
    s = staged.alias("_s")
    cond = [F.col("_s._seq_pid") == F.col("_p._seq_pid")]
    cond += [F.col(f"_s.{k}").eqNullSafe(F.col(f"_p.{k}")) for k in keys]
    joined = s.join(p, reduce(lambda a, b: a & b, cond))
    pos = F.col("_s._seq_mid") - F.col("_p._seq_first") + F.col("_p._seq_before") + F.lit(1)
    return joined.select("_s.*", pos.alias(name)).drop("_seq_pid", "_seq_mid")


def running_sum_within(df: DataFrame, keys: list[str], order: list, value: str, name: str = "running_sum",
                       partitions: int | None = None) -> DataFrame:
    """Add ``name`` = inclusive running sum of ``value`` within each key by ``order``.

    Same pattern as ``sequence_within``: range partitioning splits a hot key
    over many partitions; a window over (partition, key) sums locally (each
    such group is bounded by one range partition); a small per-(partition,
    key) total table gives the sum of earlier partitions; rows join back.
    ``order`` must be a total order.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ocols = _order_cols(order)
    kcols = [F.col(k) for k in keys]
    staged = (df.repartitionByRange(n, *kcols, *ocols)
              .withColumn("_rs_pid", F.spark_partition_id()))
    staged = cut_lineage(staged)  # one set of range bounds for both consumers
    local_w = Window.partitionBy("_rs_pid", *keys).orderBy(*ocols).rowsBetween(Window.unboundedPreceding, 0)
    local = staged.withColumn("_rs_local", F.sum(value).over(local_w))
    per_part = staged.groupBy("_rs_pid", *keys).agg(F.sum(value).alias("_rs_tot"))
    before = Window.partitionBy(*keys).orderBy("_rs_pid").rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.withColumn("_rs_before", F.coalesce(F.sum("_rs_tot").over(before), F.lit(0)))
    p = per_part.alias("_p")
    s = local.alias("_s")
    cond = [F.col("_s._rs_pid") == F.col("_p._rs_pid")]
    cond += [F.col(f"_s.{k}").eqNullSafe(F.col(f"_p.{k}")) for k in keys]
    joined = s.join(p, reduce(lambda a, b: a & b, cond))
    return joined.select("_s.*", (F.col("_s._rs_local") + F.col("_p._rs_before")).alias(name)) \
                 .drop("_rs_pid", "_rs_local")
