"""Connected components of an edge table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ticketflow.session import checkpoint_dir


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) that isn't the least of its
    component; root is that least node.

    Every node points to the least node it knows. A round hooks the parents of an
    edge's ends to the smaller one and then halves the paths, until nothing moves.
    Minima are combined before the exchange and grouped by a wrapped key, so a
    node with very many edges can be split. Rounds are tables in the shared
    checkpoint folder; an older round is deleted once the next one is written.
    """
    spark = edges.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/components-{uuid.uuid4().hex}"

    def put(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    def drop(name: str) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    both = edges.where("u <> v").select("u", "v").union(edges.where("u <> v").select("v", "u")).distinct()
    both = put(both, "edges")
    parent = put(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "0")
    no, moved = 0, parent.where("node <> root").head(1)
    while moved:
        of = parent.select(F.col("node").alias("v"), F.col("root").alias("there"))
        # the least root among a node's neighbours is offered to the node and to its root
        offered = both.join(of, "v").groupBy(F.struct("u").alias("k")).agg(F.min("there").alias("m")).select(F.col("k.u").alias("node"), "m")
        seen = parent.join(offered, "node").select("node", "root", F.least("root", "m").alias("m"))
        hooks = seen.select("node", "m").union(seen.select(F.col("root").alias("node"), "m"))
        least = hooks.groupBy(F.struct("node").alias("k")).agg(F.min("m").alias("m")).select(F.col("k.node").alias("node"), "m")
        hooked = parent.join(least, "node").select("node", F.least("root", "m").alias("hook"))
        hooked = put(hooked, f"{no + 1}-hooked")
        up = hooked.select(F.col("node").alias("hook"), F.col("hook").alias("above"))
        nxt = put(hooked.join(up, "hook").select("node", F.col("above").alias("root")), str(no + 1))
        moved = nxt.join(parent.withColumnRenamed("root", "before"), "node").where("root <> before").head(1)
        drop(f"{no + 1}-hooked")
        drop(str(no))
        parent, no = nxt, no + 1
    drop("edges")
    return parent.where("node <> root")
