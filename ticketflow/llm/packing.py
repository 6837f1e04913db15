"""Token sequences of bounded length, packed by first-fit decreasing.

A document's ids are cut into full sequences and a tail. Documents are dealt
into groups by a hash of their row, and each group packs its tails alone, the
longest first, each into the first bin that has room; a tournament tree over the
bins' free capacities finds that bin in a logarithm of their number. Bins that
stay part empty are then filled from the emptiest ones, whose tails are cut.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import prepare, with_row_id
from .encoding import encoder

CAPACITY = 1024
GROUP_ROWS = 4_096  # documents of a group on average; a group holds at most a sequence's ids of each
LEAST_CUT = 16      # room for fewer ids is left as padding


class Tournament:
    """Bins of equal capacity. Each inner node holds the larger free capacity of
    its two children, so the first bin with room for a size is found from the root."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> int:
        """The first bin with room for ``size``, which takes it."""
        free, at = self.free, 1
        if free[1] < size:
            raise ValueError("no bin has room")
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        found = at - self.leaves
        free[at] -= size
        while at > 1:
            at //= 2
            free[at] = max(free[2 * at], free[2 * at + 1])
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size; sizes are descending and at most ``capacity``."""
    tree = Tournament(len(sizes), capacity)
    return [tree.put(s) for s in sizes]


def padding(used: int, capacity: int) -> int:
    """Padding of a sequence: it is filled up to the capacity, except at a power of two."""
    return 0 if used & (used - 1) == 0 else capacity - used


def fill_up(bins: list[list[list[int]]], capacity: int, least_cut: int) -> list[list[list[int]]]:
    """Cut the pieces (item, start, length) of the emptiest bins to fill the fullest ones.

    Room for fewer than ``least_cut`` ids is left. Bins without padding stay as they are.
    """
    used = [sum(p[2] for p in b) for b in bins]
    todo = sorted((k for k in range(len(bins)) if padding(used[k], capacity)), key=lambda k: (used[k], -k))
    low, high = 0, len(todo) - 1
    while low < high:
        give, take = todo[low], todo[high]
        room = capacity - used[take]
        if room < least_cut:
            high -= 1
            continue
        piece = bins[give][-1]
        n = min(room, piece[2])
        bins[take].append([piece[0], piece[1] + piece[2] - n, n])
        piece[2] -= n
        used[take] += n
        used[give] -= n
        if not piece[2]:
            bins[give].pop()
        if not used[give]:
            low += 1
    return [b for b in bins if b]


def pack(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0,
         group_rows: int = GROUP_ROWS, least_cut: int = LEAST_CUT, seed: int = 42) -> DataFrame:
    """One row per piece: id, start (ids of its document before it), length,
    ids_crc32 (of the ids as little-endian unsigned 32-bit numbers), doc_tokens,
    sequence_id and offset in that sequence.

    A document's ids are its text's and then ``end_id``. Null and empty texts
    have the end id alone. Repeated rows and null ids are documents like any
    others. An empty table gives no rows; other columns are not read. Ids keep
    their type, which must be readable from its text form. Pieces of one sequence
    have offsets without gaps, from 0; sequence ids are unique, not gapless.

    Group sizes don't depend on any value, so copies and hot keys spread evenly;
    a group takes at most a sequence's ids of each document and the checksums of
    its full sequences.
    """
    spark = docs.sparkSession
    prepare(spark)
    with open(vocab_path, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())  # a vocabulary of fixed size
    groups = max(1, math.ceil(docs.count() / group_rows))
    kind = docs.schema[id_col].dataType
    narrow = max(encoder(file).tokenizer.get_vocab().values()) < 1 << 16 and end_id < 1 << 16
    wire = "<u2" if narrow else "<u4"  # what the tails are exchanged as

    @F.pandas_udf("n long, full array<long>, tail binary")
    def cut(texts: pd.Series) -> pd.DataFrame:
        enc, end, out = encoder(file), end_id.to_bytes(4, "little"), []
        for text in texts:
            ids = enc.encode(text or "") + end
            whole = len(ids) // (4 * capacity)
            full = [zlib.crc32(ids[4 * capacity * k:4 * capacity * (k + 1)]) for k in range(whole)]
            out.append((len(ids) // 4, full, np.frombuffer(ids, "<u4", offset=4 * capacity * whole).astype(wire).tobytes()))
        return pd.DataFrame(out, columns=["n", "full", "tail"])

    def pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
        tails = [np.frombuffer(t, wire).astype("<u4").tobytes() for t in pdf["tail"]]
        size = np.array([len(t) // 4 for t in tails], dtype=np.int64)
        place = np.lexsort((pdf["row"].to_numpy(), pdf["file"].to_numpy(), -size))
        place = place[size[place] > 0].tolist()
        bins: list[list[list[int]]] = [[] for _ in place]
        for k, b in zip(place, first_fit_decreasing(size[place].tolist(), capacity)):
            bins[b].append([k, 0, int(size[k])])
        ids, n, group = pdf["id"].tolist(), pdf["n"].tolist(), int(pdf["grp"].iloc[0])
        out, no = [], 0
        for b in fill_up([b for b in bins if b], capacity, least_cut):
            at = 0
            for k, start, length in b:
                crc = zlib.crc32(tails[k][4 * start:4 * (start + length)])
                out.append((ids[k], n[k] - int(size[k]) + start, length, crc, n[k], no, at))
                at += length
            no += 1
        for k, full in enumerate(pdf["full"]):
            for j, crc in enumerate(full):
                out.append((ids[k], j * capacity, capacity, crc, n[k], no, 0))
                no += 1
        out = pd.DataFrame(out, columns=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        out["sequence_id"] = out["sequence_id"] * groups + group
        return out

    named = with_row_id(docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")), "rid")
    tokens = named.select("id", F.col("rid.file").alias("file"), F.col("rid.row").alias("row"), cut("text").alias("t"))
    dealt = tokens.select("id", "file", "row", "t.*", F.pmod(F.xxhash64(F.lit(seed), "file", "row"), F.lit(groups)).alias("grp"))
    return (dealt.groupBy("grp").applyInPandas(pack_group, "id string, start long, length long, ids_crc32 long, doc_tokens long, "
                                                           "sequence_id long, offset long")
            .select(F.col("id").cast(kind).alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))
