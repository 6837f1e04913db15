"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position i of a fingerprint gets a nonzero vector m(i) of radius + 1
bits. For each nonzero vector v, a table keeps the bits with <m(i), v> = 1. Two
fingerprints that differ in at most ``radius`` positions put at most ``radius``
linear conditions on v, so some nonzero v makes the product 0 at all of them:
the pair has equal kept bits in that table. Nothing within the radius is missed.

Copies collapse to one fingerprint first. A bucket of more than 2^12 different
fingerprints is covered again over the bits its table left free, until at most
12 bits are free, which bounds every bucket by 2^12 members without a cap.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ticketflow.session import cut_lineage
from .common import fresh, prepare, text_bytes, with_row_id
from .components import connected_components

FREE_BITS = 12
MAX_BUCKET = 1 << FREE_BITS
_BLOCK = 1 << 16


def fingerprint(data: bytes, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text's UTF-8 bytes: ASCII lower case, words
    between ASCII white space, shingles of ``words`` words with repeats (fewer
    words: the whole sequence; none: 0), XXH64 with seed 42."""
    w = data.lower().split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < words else list(map(b" ".join, zip(*(w[k:] for k in range(words)))))
    h = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype="<u8", count=len(grams))
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), _BLOCK):
        block = h[k:k + _BLOCK]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint_column(data: Column, words: int = 3) -> Column:
    """Signed 64-bit fingerprints of a binary column."""
    @F.pandas_udf(T.LongType())
    def of(s: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, words) for x in s], dtype=np.uint64).view(np.int64))
    return of(data)


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """Masks over the given bit positions, one per nonzero vector."""
    size = 1 << (radius + 1)
    vec = {b: 1 + k % (size - 1) for k, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (vec[b] & v).bit_count() % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (member, least member it is linked with) that connect the same
    members as all links within ``radius`` bits do. At most 2^12 members."""
    x = np.unique(members.view(np.uint64))
    label = np.arange(len(x))
    near = np.empty((len(x), len(x)), dtype=bool)
    for k in range(0, len(x), 256):
        near[k:k + 256] = np.bitwise_count(x[k:k + 256, None] ^ x[None, :]) <= radius
    while True:
        new = np.array([label[row].min() for row in near])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    y = x.view(np.int64)
    return [(int(y[i]), int(y[label[i]])) for i in range(len(x)) if label[i] != i]


def links(fps: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of different
    fingerprints (column fp) that differ in at most ``radius`` bits."""
    @F.pandas_udf("array<struct<u:long,v:long>>")
    def forest(s: pd.Series) -> pd.Series:
        return pd.Series([bucket_forest(np.asarray(m, dtype=np.int64), radius) for m in s])

    level = {0: list(range(64))}  # mask -> bits it leaves free
    rows = fps.select("fp", F.lit(0).cast("long").alias("parent"))
    out = None
    while True:
        masks = {m: covering_masks(free, radius) for m, free in level.items()}
        table = F.create_map(*[x for m, own in masks.items() for x in (
            F.lit(_signed(m)).cast("long"), F.array(*[F.lit(_signed(m | o)).cast("long") for o in own]))])
        keyed = (rows.select("fp", F.explode(table[F.col("parent")]).alias("mask"))
                 .select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key")))
        # two members: they are the least and the greatest; more: gathered below
        sizes = cut_lineage(keyed.groupBy("mask", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
                            .where("n > 1"))
        pairs = sizes.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select(
            F.col("b").alias("u"), F.col("a").alias("v"))
        free_after = max(64 - bin(m | o).count("1") for m, own in masks.items() for o in own)
        last = free_after <= FREE_BITS
        fit = F.lit(True) if last else F.col("n") <= MAX_BUCKET
        several = sizes.where((F.col("n") > 2) & fit).select("mask", "key")
        # grouped by a wrapped key: the semi-join keeps exchanges of its own, which can be split
        gathered = (keyed.join(several, ["mask", "key"], "left_semi").groupBy(F.struct("mask", "key"))
                    .agg(F.collect_list("fp").alias("members")))
        edges = pairs.union(gathered.select(F.explode(forest("members")).alias("e")).select("e.u", "e.v"))
        out = edges if out is None else out.union(edges)
        big = sizes.where(F.col("n") > MAX_BUCKET).select("mask", "key")
        if last or not big.head(1):
            return out
        rows = cut_lineage(keyed.join(big, ["mask", "key"], "left_semi").select("fp", F.col("mask").alias("parent")))
        level = {m | o: [b for b in range(64) if not (m | o) >> b & 1] for m, own in masks.items() for o in own}


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                   radius: int = 2, row_id: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits),
    component_id (least id reachable over links of at most ``radius`` differing
    bits), keeper (true for one row of each component: that of the least id)
    and, if ``row_id`` names such a column, that column.

    Null and empty texts have fingerprint zero and are linked like any other.
    Null ids come after all others; a component of null ids only has a null
    component_id. Repeated rows each give a row, one of them at most a keeper.
    An empty table gives no rows; columns other than the named ones are not read.
    """
    prepare(docs.sparkSession)
    fp = fingerprint_column(text_bytes(F.col("_text")), words)
    ident = F.col(row_id) if row_id else F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))
    base = cut_lineage(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), ident.alias("_rid"))
                       .select("_id", "_rid", fp.alias("fp")))
    best = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_rid").alias("rid"))
    classes = cut_lineage(base.groupBy("fp").agg(F.min(best).alias("best")))
    star = connected_components(links(classes.select("fp"), radius))
    rooted = (classes.join(star.withColumnRenamed("node", "fp"), "fp", "left")
              .withColumn("root", F.coalesce("root", "fp")))
    linked = star.select("root").distinct()
    # only classes with links need their component's least; the others are their own
    of_root = (rooted.join(linked, "root", "left_semi").groupBy("root").agg(F.min("best").alias("least")))
    least = cut_lineage(rooted.join(of_root, "root", "left")
                        .select("fp", F.coalesce("least", "best").alias("least")))
    out = base.join(least, "fp").select(
        F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("least.id").alias("component_id"), (F.col("least.rid") == F.col("_rid")).alias("keeper"),
        *([F.col("_rid").alias(row_id)] if row_id else []))
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                         radius: int = 2, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs`` with one row of each component, all columns as they came.

    The rows to drop are (file hash, row number) pairs of 16 bytes. Up to
    ``broadcast_rows`` of them, counted first, are broadcast; beyond that the
    anti-join shuffles. Edge cases as in ``simhash_groups``.
    """
    rid = fresh(docs, "_rid")
    named = with_row_id(docs, rid)
    gone = cut_lineage(simhash_groups(named, id_col, text_col, words, radius, rid)
                       .where(~F.col("keeper")).select(rid))
    small = gone.count() <= broadcast_rows
    return named.join(F.broadcast(gone) if small else gone, rid, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
