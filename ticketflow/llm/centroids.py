"""Centroid clustering of integer vectors, with the threshold algorithm.

For every dimension the centroids are held sorted by their value there. A
vector's lists are walked outward from its own values, nearest entry first, one
entry of every dimension a round. A centroid met for the first time gets its
exact distance. One that wasn't met in any dimension is at least as far as the
frontier in all of them, so the walk ends when the frontier's squared distances
add up to strictly more than the best exact distance.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ticketflow.session import cut_lineage, ship_package
from .common import Staged

SMALL = 1 << 27        # components up to this have squared distances that fit 64 bits
LARGEST = 1 << 60      # vectors with a larger component take no part
MOST = (1 << 63) - 1
FAR = 1 << 61          # past the end of a list


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) per row of ``q``; ties
    to the smaller number. Both arrays hold integers: int64, or Python's own."""
    count, dims = centroids.shape
    order = np.argsort(centroids, axis=0, kind="stable").T
    value = np.take_along_axis(centroids.T, order, axis=1)
    n = len(q)
    who, best = np.full(n, count), np.full(n, MOST, dtype=q.dtype)
    if q.dtype == object:
        best = best + MOST ** 3  # Python integers have no largest one
    rows = np.arange(n)  # vectors that are still walking
    right = np.stack([np.searchsorted(value[d], q[:, d]) for d in range(dims)], axis=1) if n else np.zeros((0, dims), int)
    left, seen, dim = right - 1, np.zeros((n, count), dtype=bool), np.arange(dims)
    while len(rows):
        down = np.where(left >= 0, q - value[dim, np.maximum(left, 0)], FAR)
        up = np.where(right < count, value[dim, np.minimum(right, count - 1)] - q, FAR)
        is_left = down <= up
        frontier = np.where(is_left, down, up)
        met = np.zeros_like(seen)
        met[np.arange(len(rows))[:, None], order[dim, np.where(is_left, left, right)]] = True
        r, k = np.nonzero(met & ~seen)
        exact = ((q[r] - centroids[k]) ** 2).sum(axis=1)
        # of a row's new centroids in ascending number, the first of least distance
        place = np.lexsort((k, exact, r)) if exact.dtype != object else np.array(sorted(range(len(r)), key=lambda i: (r[i], exact[i], k[i])), dtype=int)
        r, k, exact = r[place], k[place], exact[place]
        first = np.ones(len(r), dtype=bool)
        first[1:] = r[1:] != r[:-1]
        r, k, exact, at = r[first], k[first], exact[first], rows[r[first]]
        better = (exact < best[at]) | ((exact == best[at]) & (k < who[at]))
        best[at[better]], who[at[better]] = exact[better], k[better]
        seen |= met
        left, right = left - is_left, right + ~is_left
        walking = ~(((frontier ** 2).sum(axis=1) > best[rows]) | seen.all(axis=1))
        rows, q, left, right, seen = rows[walking], q[walking], left[walking], right[walking], seen[walking]
    return who, best


def _integers(column: pa.Array, dims: int) -> np.ndarray:
    q = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return q.astype(np.int64)


def _assign(q: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """As ``nearest``, in 64 bits where they suffice; distances end at the largest long."""
    c = np.array(centroids, dtype=np.int64)
    wide = (np.abs(q) > SMALL).any(axis=1) | bool((np.abs(c) > SMALL).any())
    who, far = np.zeros(len(q), dtype=np.int64), np.zeros(len(q), dtype=np.int64)
    if not wide.all():
        who[~wide], far[~wide] = nearest(q[~wide], c)
    if wide.any():
        k, d = nearest(q[wide].astype(object), c.astype(object))
        who[wide], far[wide] = k, np.array([min(int(x), MOST) for x in d], dtype=np.int64)
    return who, far


def kept_vectors(embeddings: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, q): vectors of ``dims`` components as integers floor(scale * x)."""
    v = F.col("v")
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    fits = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * F.lit(float(scale))) < float(LARGEST)))
    return (embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
            .where(F.coalesce((F.size(v) == dims) & fits, F.lit(False))).select("id", scaled.alias("q")))


def _sums(vectors: DataFrame, centroids: list[list[int]], dims: int) -> dict[int, tuple[int, list[int]]]:
    """Per cluster: rows and componentwise sums; one row per cluster and dimension reaches the driver."""
    def partial(batches):
        n = [0] * len(centroids)
        total = [[0] * dims for _ in centroids]
        for batch in batches:
            q = _integers(batch.column(0), dims)
            who, _ = _assign(q, centroids)
            low, high = q & 0xFFFFFFFF, q >> 32  # halves, whose sums over a batch fit 64 bits
            for k in np.unique(who).tolist():
                own = who == k
                n[k] += int(own.sum())
                total[k] = [t + a + (b << 32) for t, a, b in zip(total[k], low[own].sum(axis=0).tolist(), high[own].sum(axis=0).tolist())]
        rows = [(k, d, n[k], str(total[k][d])) for k in range(len(centroids)) if n[k] for d in range(dims)]
        cols = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                                          pa.array(cols[3], pa.string())], names=["k", "d", "n", "s"])

    out: dict = {}
    for r in (vectors.select("q").mapInArrow(partial, "k int, d int, n long, s string").groupBy("k", "d")
              .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()):
        out.setdefault(r["k"], (r["n"], [0] * dims))[1][r["d"]] = int(r["s"])
    return out


def cluster(embeddings: DataFrame, clusters: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: id, cluster, distance (squared, to its centroid),
    cluster_inertia and inertia (distances added up over its cluster and over
    all), centroid_sha256 (of the centroid's components, joined by commas).

    Centroids 0, 1, ... start as the kept vectors with the smallest SHA-256 of
    ``seed:id``, in that order (equal ones by vector; a null id comes last). In
    each round every vector goes to its nearest centroid, ties to the smaller
    number, and every centroid with vectors becomes the componentwise floor of
    their mean; then vectors are assigned once more.

    Null vectors, vectors of another length, and those with a null or non-finite
    component or one beyond 2^60 after scaling take no part. Repeated rows count
    each. With fewer vectors than clusters there are as many centroids as
    vectors; an empty table gives no rows. Distances and their sums end at the
    largest long. Other columns are not read.
    """
    spark = embeddings.sparkSession
    ship_package(spark)
    vectors = Staged(spark).put(kept_vectors(embeddings, dims, scale, id_col, vector_col))
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    centroids = [list(r["q"]) for r in vectors.select("q", mark.alias("h")).orderBy(F.col("h").asc_nulls_last(), "q").limit(clusters).collect()]
    for _ in range(rounds if centroids else 0):
        moved = list(centroids)
        for k, (n, sums) in _sums(vectors, centroids, dims).items():
            moved[k] = [s // n for s in sums]
        if moved == centroids:  # later rounds would change nothing
            break
        centroids = moved

    def last(batches):
        for batch in batches:
            who, far = _assign(_integers(batch.column(1), dims), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(who, pa.int32()), pa.array(far, pa.int64())], names=["id", "cluster", "distance"])

    kind = vectors.schema["id"].dataType.simpleString()
    done = cut_lineage(vectors.select("id", "q").mapInArrow(last, f"id {kind}, cluster int, distance long"))
    inertia = {r["cluster"]: int(r["s"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    of = lambda values, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in values] or [F.lit(None).cast(kind)]), F.col("cluster") + 1)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return done.select(F.col("id").alias(id_col), "cluster", "distance",
                       of([min(inertia.get(k, 0), MOST) for k in range(len(centroids))], "long").alias("cluster_inertia"),
                       F.lit(min(sum(inertia.values()), MOST)).cast("long").alias("inertia"), of(sha, "string").alias("centroid_sha256"))
