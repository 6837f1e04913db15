"""Similar tickets (K5): MinHash bands, then exact Jaccard on word shingles.

Texts of equal words form a class; only one text of a class goes on. Its shingles
(five words in a row) are hashed and a signature of minima is cut into bands; two
texts of Jaccard s share a band of r rows with probability s ** r. A bucket holds
the classes of one band value. Each of its pairs is compared by the shingles
themselves, so no wrong pair is given, and a pair of at least ``threshold`` is
missed with the probability that ``miss_probability`` states.

A bucket of many classes that are not alike (they share some common passage) is
split by further bands of more rows; one that stays big after that holds texts
that are alike, and is compared in blocks, spread over the cluster.

Near copies share most of their bands. A bucket is therefore held as ids only, its
classes once for all bands that bring the same ones together, and a small one as
pairs of ids, each compared once: shingles travel per pair or set, not per band.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ticketflow.operators.components import connected_components
from ticketflow.session import cut_lineage, ship_package

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4            # first bands
MORE_BANDS, MORE_ROWS = 64, 8  # bands that split a big bucket
BIG = 1_000                    # classes of a bucket that is compared at once, and of a block
FEW = 16                       # classes of a bucket whose pairs are listed by id


def miss_probability(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """That two texts of this similarity share no band."""
    return (1 - similarity ** rows) ** bands


def _multipliers(n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(salt)
    return rng.integers(1, 1 << 62, n, dtype=np.uint64) * 2 + 1, rng.integers(0, 1 << 62, n, dtype=np.uint64)


def band_keys(shingles: np.ndarray, bands: int, rows: int, salt: int) -> np.ndarray:
    """One 64-bit key per band of the signature of a set of 64-bit hashes."""
    a, b = _multipliers(bands * rows, salt)
    x = shingles.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(x), 256):  # a bounded table of products
        h = x[k:k + 256, None] * a + b
        least = np.minimum(least, (h ^ (h >> np.uint64(29))).min(axis=0))
    key = np.zeros(bands, dtype=np.uint64)
    for row in least.reshape(bands, rows).T:
        key = (key ^ row) * np.uint64(0x100000001B3)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _words(text: str):
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def _classes(docs: DataFrame, id_col: str, text: str, words: int) -> tuple[DataFrame, DataFrame]:
    """((id, class_id), (class_id, shingles)): texts of equal words have the least id's class."""
    joined = F.concat_ws(" ", _words(text))
    keyed = cut_lineage(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.sha2(joined, 256).alias("s")))
    # grouped by a wrapped key, so that the join back has exchanges of its own and can be split
    least = keyed.groupBy(F.struct("s").alias("k")).agg(F.min("id").alias("class_id")).select(F.col("k.s").alias("s"), "class_id")
    members = keyed.join(least, "s").select("id", "class_id").distinct()
    firsts = docs.select(F.col(id_col).alias("class_id"), text).join(least.select("class_id"), "class_id", "left_semi")
    w = F.col("w")
    last = F.greatest(F.size(w) - F.lit(words - 1), F.lit(1))
    hashed = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(w, i, words))))
    shingled = (firsts.select("class_id", _words(text).alias("w")).where(F.size("w") > 0)
                .select("class_id", F.array_sort(F.array_distinct(hashed)).alias("shingles")))
    # rows that repeat an id with other texts: the class is that of the first text by its shingles
    return members, shingled.groupBy("class_id").agg(F.min("shingles").alias("shingles"))


def _banded(classes: DataFrame, bands: int, rows: int, salt: int) -> DataFrame:
    """(band, key, class_id) of every bucket with two classes or more, and its size n."""
    @F.pandas_udf("array<long>")
    def keys(shingles: pd.Series) -> pd.Series:
        return pd.Series([band_keys(np.asarray(s), bands, rows, salt) for s in shingles])

    keyed = cut_lineage(classes.select("class_id", F.posexplode(keys("shingles")).alias("band", "key")))
    shared = (keyed.groupBy(F.struct("band", "key").alias("k")).agg(F.count("*").alias("n")).where("n > 1")
              .select(F.col("k.band").alias("band"), F.col("k.key").alias("key"), "n"))
    return cut_lineage(keyed.join(shared, ["band", "key"]))


def _sets(buckets: DataFrame) -> DataFrame:
    """(members, one): the classes of buckets of at most ``BIG``, once for all
    buckets that hold the same ones, and the band and key of one of them."""
    sets = (buckets.where(F.col("n") <= BIG).groupBy(F.struct("band", "key").alias("one"))
            .agg(F.array_sort(F.collect_list("class_id")).alias("members")))
    return cut_lineage(sets.groupBy("members").agg(F.min("one").alias("one")))


def _listed_pairs(sets: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b, of the pairs of small sets, each compared once."""
    m = F.col("members")
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(m) - 1), lambda i: F.transform(
        F.slice(m, i + 1, F.size(m)), lambda b: F.struct(F.element_at(m, i).alias("a"), b.alias("b")))))
    listed = sets.where(F.size(m) <= FEW).select(F.inline(pairs)).distinct()
    one = classes.select(F.col("class_id").alias("a"), F.col("shingles").alias("x"))
    two = classes.select(F.col("class_id").alias("b"), F.col("shingles").alias("y"))
    both = listed.join(one, "a").join(two, "b")
    # sets whose sizes alone keep them below the threshold aren't compared
    n, m = F.size("x"), F.size("y")
    both = both.where(F.least(n, m) >= F.floor(F.greatest(n, m) * F.lit(threshold)))
    shared = both.select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("k"))
    return (shared.select("a", "b", (F.col("k") / (F.col("n") - F.col("k")).cast("double")).alias("similarity"))
            .where(F.col("similarity") >= threshold))


def _bucket_pairs(buckets: DataFrame, classes: DataFrame, threshold: float, split_big: bool) -> DataFrame:
    """(a, b, similarity) of the pairs of buckets, those of more than ``BIG`` classes left out with ``split_big``."""
    sets = _sets(buckets)
    larger = sets.where(F.size("members") > FEW).select("one.band", "one.key", F.size("members").cast("long").alias("n"), F.explode("members").alias("class_id"))
    if not split_big:
        larger = larger.unionByName(buckets.where(F.col("n") > BIG).select("band", "key", "n", "class_id"))
    return _listed_pairs(sets, classes, threshold).unionByName(_pairs_in(larger.join(classes, "class_id"), threshold))


def alike(shingles: list[np.ndarray], others: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, similarity) of the pairs of two lists of shingle sets with
    a Jaccard similarity of at least ``threshold``."""
    n, m = len(shingles), len(others)
    sizes, sizes2 = np.array([len(s) for s in shingles]), np.array([len(s) for s in others])
    shared = np.zeros((n, m), dtype=np.float32)  # counts below 2 ** 24 are exact
    every = np.concatenate([*shingles, *others])
    values, at = np.unique(every, return_inverse=True)
    row, col = np.repeat(np.arange(n), sizes), np.repeat(np.arange(m), sizes2)
    left, right = at[:len(row)], at[len(row):]
    both = np.intersect1d(left, right)
    step = max(1, 8_000_000 // (n + m))  # shingles of one matrix product
    for k in range(0, len(both), step):
        some = both[k:k + step]
        a, b = np.zeros((n, len(some)), dtype=np.float32), np.zeros((m, len(some)), dtype=np.float32)
        for table, who, what in ((a, row, left), (b, col, right)):
            place = np.searchsorted(some, what)
            hit = (place < len(some)) & (some[np.minimum(place, len(some) - 1)] == what)
            table[who[hit], place[hit]] = 1
        shared += a @ b.T
    union = sizes[:, None] + sizes2[None, :] - shared
    similarity = shared.astype(np.float64) / union
    r, c = np.nonzero(similarity >= threshold)
    return r, c, similarity[r, c]


def _pairs_in(buckets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b, of every bucket's pairs: blocks of a bucket meet
    block by block, so a task holds two blocks at most."""
    kind = buckets.schema["class_id"].dataType.simpleString()
    blocks = F.ceil(F.col("n") / F.lit(BIG)).cast("int")
    placed = buckets.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    # a block meets itself and every other one, under the pair (smaller, larger)
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class_id", "shingles")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        one = pdf[pdf["block"] == i]
        two = one if i == j else pdf[pdf["block"] == j]
        if not len(one) or not len(two):
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        r, c, s = alike(list(one["shingles"]), list(two["shingles"]), threshold)
        a, b = one["class_id"].to_numpy()[r], two["class_id"].to_numpy()[c]
        keep = a < b if i == j else a != b
        a, b, s = a[keep], b[keep], s[keep]
        swap = a > b
        return pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b), "similarity": s})

    return met.groupBy("band", "key", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}, similarity double")


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS,
                  threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """K5: (pairs, members).

    pairs: (a, b, similarity) of the classes, a < b, whose sets of ``words``-word
    shingles have a Jaccard similarity of at least ``threshold``. members: one row
    per id with its class_id (the least id of the texts of equal words) and
    group_id (the least class reached over pairs).

    Words are the lower-cased text between white space; a text of fewer words is
    one shingle, one without words is in the class of all such texts and in no
    pair. Rows without an id take no part; repeated rows count once.
    """
    ship_package(docs.sparkSession)
    members, classes = _classes(docs, id_col, text, words)
    members, classes = cut_lineage(members), cut_lineage(classes)
    buckets = _banded(classes, BANDS, ROWS, 1)
    pairs = _bucket_pairs(buckets, classes, threshold, split_big=True)
    big = buckets.where(F.col("n") > BIG).select("class_id").distinct()
    if big.head(1):
        further = _banded(classes.join(big, "class_id", "left_semi"), MORE_BANDS, MORE_ROWS, 2)
        pairs = pairs.unionByName(_bucket_pairs(further, classes, threshold, split_big=False))
    pairs = cut_lineage(pairs.distinct())
    roots = connected_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    groups = members.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        F.col("id").alias(id_col), "class_id", F.coalesce("root", "class_id").alias("group_id"))
    return pairs, groups
