"""Replay-safe sinks for ``foreachBatch``.

A small table (KPI windows, snapshots) lives in versioned folders ``<base>/v<batch id + 1>`` with a
``_CURRENT`` pointer written last: a rename that overwrites in one call, so a
reader finds the old pointer or the new one, never none.
A batch that is replayed after a failure rewrites the same version from the
same inputs, so the sink is idempotent; readers never see a half-written
version. Tables that grow with the data are ``state_table.StateTable``s, in which
a batch writes its own rows only; ``read_current`` reads both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "_CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def current_version(spark: SparkSession, base: str) -> str | None:
    fs, _, jvm = _fs(spark, base)
    ptr = jvm.org.apache.hadoop.fs.Path(base + "/" + POINTER)
    if not fs.exists(ptr):
        return None
    stream = fs.open(ptr)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        name = reader.readLine()
    finally:
        stream.close()
    return base + "/" + name.strip()


def read_current(spark: SparkSession, base: str, schema=None) -> DataFrame | None:
    v = current_version(spark, base)
    if v is None:
        return None if schema is None else spark.createDataFrame([], schema)
    from ticketflow.streaming.state_table import manifest_of, read_manifest  # that module uses this one
    m = manifest_of(spark, v)
    return spark.read.parquet(v) if m is None else read_manifest(spark, base.rstrip("/"), m)


def publish(spark: SparkSession, base: str, version: str) -> None:
    fs, _, jvm = _fs(spark, base)
    Path = jvm.org.apache.hadoop.fs.Path
    tmp = Path(base + "/" + POINTER + "." + version)
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(version.encode("utf-8")))
    finally:
        out.close()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(tmp, Path(base + "/" + POINTER), how)


def _number(version_path: str | None) -> int:
    if not version_path:
        return -1
    name = version_path.rstrip("/").rsplit("/", 1)[-1]
    return int(name[1:]) if name.startswith("v") and name[1:].isdigit() else -1


def committed(spark: SparkSession, base: str, batch_id: int) -> bool:
    """True when the version of ``batch_id`` (or a later one) is already published."""
    return _number(current_version(spark, base)) >= batch_id + 1


def expire(spark: SparkSession, base: str, keep: int) -> None:
    """Delete all but the newest ``keep`` versions up to the published one."""
    fs, root, _ = _fs(spark, base)
    done = _number(current_version(spark, base))
    old = sorted(n for n in (_number(str(x.getPath().getName())) for x in fs.listStatus(root)) if 0 <= n <= done)[:-keep]
    for n in old:
        fs.delete(_fs(spark, f"{base}/v{n:012d}")[1], True)


def write_version(df: DataFrame, base: str, batch_id: int, keep: int = 3) -> str | None:
    """Publish ``df`` as the version of ``batch_id`` (-1 seeds the table).

    A batch whose version is already published is skipped, so a replay
    after a failure between publish and the stream's commit is a no-op; a
    replay after a failure before publish rewrites only its own folder. The
    newest ``keep`` versions stay, for readers that still scan an older one.
    """
    spark = df.sparkSession
    if committed(spark, base, batch_id):
        return None
    name = f"v{batch_id + 1:012d}"
    df.write.mode("overwrite").parquet(base + "/" + name)
    publish(spark, base, name)
    expire(spark, base, keep)
    return base + "/" + name


def write_part(df: DataFrame, base: str, batch_id: int) -> None:
    """The rows a batch appends, in a folder of its own: a replay rewrites it. It
    counts once the batch is published elsewhere (see ``read_parts``)."""
    df.write.mode("overwrite").parquet(f"{base.rstrip('/')}/v{batch_id + 1:012d}")


def read_parts(spark: SparkSession, base: str, published: str | None, schema) -> DataFrame:
    """The rows appended by batches up to the published version of the table they belong to."""
    done = _number(published)
    fs, root, _ = _fs(spark, base)
    names = [str(x.getPath().getName()) for x in fs.listStatus(root)] if fs.exists(root) else []
    paths = [f"{base.rstrip('/')}/{n}" for n in sorted(names) if 0 <= _number(n) <= done]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_batch(batch: DataFrame, batch_id: int, base: str, keys: list[str],
                 order_col: str | None = None) -> None:
    """Merge a micro-batch into the state table: the newest row per key wins,
    whether it is stored or arrives (an arriving row wins a tie).

    Without ``order_col`` the arriving row replaces the stored one; a batch
    with several rows of one key is then an error, not an arbitrary choice.
    """
    spark = batch.sparkSession
    if committed(spark, base, batch_id):
        return
    cols = batch.columns
    if not order_col and batch.groupBy(*keys).count().where("count > 1").head(1):
        raise ValueError(f"several rows for one key of {keys}: name a column that orders them")
    cur = read_current(spark, base)
    both = batch.withColumn("_new", F.lit(1))
    if cur is not None:
        both = cur.select(*cols).withColumn("_new", F.lit(0)).unionByName(both)
    order = F.struct(order_col, "_new") if order_col else F.col("_new")
    newest = F.max_by(F.struct(*cols), order).alias("_r")
    merged = both.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(newest).select("_r.*")
    # the new version goes to its own folder, so reading the previous one while writing is safe
    write_version(merged.select(*cols), base, batch_id)
