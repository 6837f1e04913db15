"""State tables merged on read: a batch writes its own rows only.

A table's rows are dealt into buckets by a hash of the key. A bucket has base
files and, per batch that touched it, delta files. A reader takes the newest row
per key of buckets that have deltas and reads the others as they are. A bucket
whose deltas have grown to a share of its base is rewritten, alone, by the batch
that makes it so. Each batch publishes one version: a manifest that names the
folders of every bucket, then the pointer. A replayed batch rewrites its own
folder from the same inputs or, once published, does nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketflow.streaming import sinks

MANIFEST = "manifest.json"
BUCKET, SEQ = "__bucket", "__seq"
BUCKETS = 16
COMPACT_SHARE = 0.3  # delta rows of a bucket, as a share of its base rows, that make it be rewritten
MOST_DELTAS = 16     # delta folders of a bucket that make it be rewritten


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p, jvm = sinks._fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p, _ = sinks._fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def manifest_of(spark: SparkSession, version_path: str | None) -> dict | None:
    """The manifest of a version folder, or None where it is a whole-table version."""
    text = _read_text(spark, f"{version_path}/{MANIFEST}") if version_path else None
    return json.loads(text) if text else None


def read_manifest(spark: SparkSession, base: str, m: dict, buckets: list[int] | None = None) -> DataFrame:
    """The rows that a manifest publishes, of all buckets or of the given ones."""
    schema = T.StructType.fromJson(m["schema"])
    stored = T.StructType([*schema.fields, T.StructField(SEQ, T.LongType())])
    wanted = sorted(set(m["base"]) | set(m["deltas"])) if buckets is None else [str(b) for b in buckets]

    def files(folders: list[tuple[str, str]]) -> DataFrame:
        paths = [f"{base}/{folder}/{BUCKET}={b}" for b, folder in folders]
        return spark.read.schema(stored).parquet(*paths) if paths else spark.createDataFrame([], stored)

    changed = [b for b in wanted if m["deltas"].get(b)]
    still = files([(b, m["base"][b]) for b in wanted if b in m["base"] and b not in set(changed)]).drop(SEQ)
    if not changed:
        return still
    merged = files([(b, f) for b in changed for f in [*([m["base"][b]] if b in m["base"] else []), *m["deltas"][b]]])
    order = F.struct(m["order"], SEQ) if m["order"] else F.col(SEQ)
    newest = (merged.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(m["keys"])])
              .agg(F.max_by(F.struct(*schema.names), order).alias("__r")).select("__r.*"))
    return still.unionByName(newest)


class StateTable:
    """A keyed table under ``base``. With ``order_col`` the newest row per key
    wins, stored or arriving (an arriving row wins a tie); without it the
    arriving row does. A null key is a key."""

    def __init__(self, spark: SparkSession, base: str, keys: list[str], order_col: str | None = None,
                 buckets: int = BUCKETS, compact_share: float = COMPACT_SHARE):
        self.spark, self.base, self.keys, self.order = spark, base.rstrip("/"), keys, order_col
        self.buckets, self.compact_share = buckets, compact_share

    def _manifest(self) -> dict | None:
        return manifest_of(self.spark, sinks.current_version(self.spark, self.base))

    def bucket(self, m: dict | None = None):
        """The bucket of a row, from its key columns."""
        return F.pmod(F.xxhash64(*self.keys), F.lit(m["buckets"] if m else self.buckets)).cast("int")

    def read(self) -> DataFrame | None:
        """The published rows; None before the first version."""
        return sinks.read_current(self.spark, self.base)

    def read_keys(self, keys: DataFrame) -> DataFrame | None:
        """The published rows whose key is among ``keys`` (key columns of the
        table's names); only the buckets of these keys are read."""
        m = self._manifest()
        rows = self.read() if m is None else None
        own = keys.select(*self.keys).distinct()
        if m is not None:
            touched = [r[0] for r in own.select(self.bucket(m)).distinct().collect()]  # at most one per bucket
            rows = read_manifest(self.spark, self.base, m, sorted(touched))
        if rows is None:
            return None
        marked = own.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.keys)])
        same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(self.keys)]
        return rows.join(marked, same, "left_semi")

    def newest(self, batch: DataFrame, cols: list[str] | None = None) -> DataFrame:
        """One row per key: the newest; of equally new ones always the same."""
        cols = cols or batch.columns
        if not self.order:
            if batch.groupBy(*self.keys).count().where("count > 1").head(1):
                raise ValueError(f"several rows for one key of {self.keys}: name a column that orders them")
            return batch.select(*cols)
        return (batch.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.keys)])
                .agg(F.max_by(F.struct(*cols), F.struct(self.order, F.xxhash64(*cols))).alias("__r")).select("__r.*"))

    def _write(self, rows: DataFrame, m: dict, folder: str, seq: int) -> dict[str, int]:
        """Write rows to a folder by bucket; rows per bucket that has any."""
        stamped = rows.withColumn(BUCKET, self.bucket(m)).withColumn(SEQ, F.lit(seq).cast("long"))
        path = f"{self.base}/{folder}"
        stamped.repartition(m["buckets"], BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
        schema = T.StructType([*stamped.drop(BUCKET).schema.fields, T.StructField(BUCKET, T.IntegerType())])
        return {str(r[0]): r[1] for r in self.spark.read.schema(schema).parquet(path).groupBy(BUCKET).count().collect()}

    def extra(self) -> dict:
        """What the last batch published beside its rows (a watermark, a high-water mark)."""
        return (self._manifest() or {}).get("extra", {})

    def upsert(self, batch: DataFrame, batch_id: int, keep: int = 3, extra: dict | None = None) -> str | None:
        """Publish ``batch`` as a version (-1 seeds the table); None for a replay of
        a published one. ``extra`` is a few values published with it, in one step."""
        if sinks.committed(self.spark, self.base, batch_id):
            return None
        name = f"v{batch_id + 1:012d}"
        m = self._manifest()
        whole = self.read() if m is None else None  # a table written whole before: taken into buckets once
        fresh = m is None
        if fresh:
            schema = (batch if whole is None else whole).schema
            m = {"buckets": self.buckets, "keys": self.keys, "order": self.order, "schema": json.loads(schema.json()),
                 "base": {}, "deltas": {}, "rows": {}, "delta_rows": {}, "seq": 0}
        cols = [f["name"] for f in m["schema"]["fields"]]
        batch = batch.select(*cols)
        m["seq"] += 1
        if extra is not None:
            m["extra"] = extra
        if whole is not None:
            m["rows"] = self._write(whole, m, f"{name}/whole", 0)
            m["base"] = {b: f"{name}/whole" for b in m["rows"]}
        kind = "base" if fresh and whole is None else "delta"
        for b, n in self._write(self.newest(batch, cols), m, f"{name}/{kind}", m["seq"]).items():
            if kind == "base":
                m["base"][b], m["rows"][b] = f"{name}/base", n
            else:
                m["deltas"].setdefault(b, []).append(f"{name}/delta")
                m["delta_rows"][b] = m["delta_rows"].get(b, 0) + n
        full = [b for b, d in m["deltas"].items()
                if d and (m["delta_rows"][b] > self.compact_share * m["rows"].get(b, 0) or len(d) > MOST_DELTAS)]
        if full:
            rows = self._write(read_manifest(self.spark, self.base, m, full), m, f"{name}/compacted", m["seq"])
            for b in full:
                m["base"][b], m["rows"][b] = f"{name}/compacted", rows[b]
                m["deltas"].pop(b)
                m["delta_rows"].pop(b)
        _write_text(self.spark, f"{self.base}/{name}/{MANIFEST}", json.dumps(m))
        sinks.publish(self.spark, self.base, name)
        self._expire(keep)
        return f"{self.base}/{name}"

    def _expire(self, keep: int) -> None:
        """Delete folders that none of the newest ``keep`` versions names."""
        fs, root, jvm = sinks._fs(self.spark, self.base)
        done = sinks._number(sinks.current_version(self.spark, self.base))
        numbers = sorted(n for n in (sinks._number(str(x.getPath().getName())) for x in fs.listStatus(root)) if 0 <= n <= done)
        named = set()
        for n in numbers[-keep:]:
            version = f"v{n:012d}"
            named.add(version)
            m = manifest_of(self.spark, f"{self.base}/{version}") or {"base": {}, "deltas": {}}
            named |= {f.split("/")[0] for f in [*m["base"].values(), *(f for d in m["deltas"].values() for f in d)]}
        for n in numbers[:-keep]:
            if f"v{n:012d}" not in named:
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.base}/v{n:012d}"), True)
