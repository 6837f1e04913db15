"""Balanced shards by histogram sort.

Rows are sorted by a 64-bit key. Splitters between shards are found by
counting: each round counts the exact bytes below a set of candidate keys
across all partitions and narrows every splitter's interval, until the bytes
below each splitter meet the tolerance. Then rows are exchanged once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ticketflow.session import cut_lineage
from .common import fresh, prepare, text_bytes, with_row_id

PROBES = 32  # candidates per splitter and round
MAX_RANGES = 1 << 16  # key ranges of all shards; their bounds and row counts are held by the driver and every task


def _histogram(keyed: DataFrame, bounds: list[int]) -> list[tuple[int, int]]:
    """(bytes, rows) per bucket; a key's bucket is the number of bounds <= key."""
    edges = np.array(bounds, dtype=np.int64)

    def count(batches):
        size = np.zeros(len(edges) + 1, dtype=np.int64)
        rows = np.zeros(len(edges) + 1, dtype=np.int64)
        for pdf in batches:
            at = np.searchsorted(edges, pdf["key"].to_numpy(), side="right")
            np.add.at(size, at, pdf["size"].to_numpy())
            rows += np.bincount(at, minlength=len(rows))
        full = np.nonzero(rows)[0]
        yield pd.DataFrame({"b": full, "size": size[full], "n": rows[full]})

    got = {r["b"]: (r["size"], r["n"]) for r in keyed.select("key", "size").mapInPandas(count, "b long, size long, n long")
           .groupBy("b").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect()}
    return [got.get(b, (0, 0)) for b in range(len(edges) + 1)]


def find_splitters(keyed: DataFrame, shards: int, tolerance: float) -> tuple[list[int], int]:
    """(splitters, total bytes): shard of a key = number of splitters <= key.

    The bytes below splitter j are within ``tolerance`` mean shard sizes of j
    shares of the total, or as near as any key gets (one row may be larger).
    """
    lo_key, hi_key, total = keyed.agg(F.min("key"), F.max("key"), F.sum("size")).first()
    if total is None:
        return [], 0
    target = [total * j / shards for j in range(1, shards)]
    near = tolerance * total / shards
    low = [(lo_key, 0)] * len(target)  # (key, bytes below it), below the target
    high = [(hi_key + 1, total)] * len(target)
    best: list = [min((lo_key, 0), (hi_key + 1, total), key=lambda x: abs(x[1] - t)) for t in target]
    while True:
        open_ = [j for j, t in enumerate(target) if abs(best[j][1] - t) > near and high[j][0] - low[j][0] > 1]
        if not open_:
            return [min(b[0], (1 << 63) - 1) for b in best], total
        probes = sorted({low[j][0] + (high[j][0] - low[j][0]) * k // (PROBES + 1)
                         for j in open_ for k in range(1, PROBES + 1)} - {low[j][0] for j in open_})
        if not probes:
            probes = sorted({low[j][0] + 1 for j in open_})
        below, at = 0, []
        for key, (size, _) in zip(probes, _histogram(keyed, probes)):
            below += size
            at.append((key, below))
        for j in open_:
            for x in at:
                if abs(x[1] - target[j]) < abs(best[j][1] - target[j]):
                    best[j] = x
                if x[1] <= target[j] and x[0] > low[j][0]:
                    low[j] = x
                if x[1] >= target[j] and x[0] < high[j][0]:
                    high[j] = x


def histogram_shards(df: DataFrame, id_col: str, text_col: str, shards: int = 16, tolerance: float = 0.001,
                     part_bytes: int = 32 << 20, seed: int = 42, keep: list[str] | None = None,
                     extra: dict[str, Column] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``, and ``extra`` columns computed before the
    exchange) with size (UTF-8 bytes + 1), shard (0 to
    shards - 1) and slot (gapless from 0 in each shard). An input column of one
    of these names is replaced.

    The sort key is a hash of the id and of the row's identity, so shards are
    shuffled, repeated rows and null ids spread like any others, and a group of
    copies of any size can be split. Null and empty texts have size 1. An empty
    table gives no rows. Each shard is exchanged as several key ranges of about
    ``part_bytes``, or of more where that made over 65,536 of them, one task each,
    so no task holds a shard.
    """
    spark = df.sparkSession
    prepare(spark)
    rid = fresh(df, "_rid")
    named = with_row_id(df, rid)
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(rid))
    size = F.octet_length(text_bytes(text_col)).cast("long") + 1
    keyed = cut_lineage(named.select(key.alias("key"), size.alias("size")))
    splitters, total = find_splitters(keyed, shards, tolerance)
    # each shard's key interval, cut into ranges of about part_bytes
    cuts = max(1, min(math.ceil(total / shards / part_bytes), MAX_RANGES // shards))
    ends = [-(1 << 63), *splitters, 1 << 63]
    starts = [lo + (hi - lo) * k // cuts for lo, hi in zip(ends, ends[1:]) for k in range(cuts)]
    shard_of = [j for j in range(len(ends) - 1) for _ in range(cuts)]
    offsets, last, n = [], -1, 0
    for j, (_, rows) in zip(shard_of, _histogram(keyed, starts[1:]) if total else []):
        n = 0 if j != last else n
        offsets.append(n)
        last, n = j, n + rows
    edges = np.array(starts[1:], dtype=np.int64)
    of_part = np.array(shard_of, dtype=np.int32)
    skip = np.array(offsets or [0] * len(shard_of), dtype=np.int64)

    @F.pandas_udf("part int, shard int, skip long")
    def place(k: pd.Series) -> pd.DataFrame:
        p = np.searchsorted(edges, k.to_numpy(), side="right")
        return pd.DataFrame({"part": p.astype(np.int32), "shard": of_part[p], "skip": skip[p]})

    # a window over the range is the one exchange of whole rows
    cols = [c for c in (keep or df.columns) if c.lower() not in ("size", "shard", "slot")]
    k, at = fresh(df, "_key"), fresh(df, "_at")
    placed = (named.select(*[F.col(f"`{c}`") for c in cols], F.col(rid), key.alias(k), size.alias("size"),
                           *[c.alias(x) for x, c in (extra or {}).items()])
              .withColumn(at, place(F.col(k))))
    w = Window.partitionBy(f"{at}.part").orderBy(k, rid)
    return placed.select(*[F.col(f"`{c}`") for c in cols], *(extra or {}), "size", F.col(f"{at}.shard").alias("shard"),
                         (F.col(f"{at}.skip") + F.row_number().over(w) - 1).alias("slot"))
