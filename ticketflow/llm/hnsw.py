"""Nearest neighbours by hierarchical navigable small-world graphs, one a shard.

Equal vectors become one node with its k + 1 least ids: no query needs more of
them, and copies would cut a graph into islands. Shards hold a bounded number
of nodes. A shard's index is one row of flat arrays: vectors, levels, and the
neighbours of all nodes and levels. Queries run against every shard in blocks,
each shard gives its best per query, and the shards' results are merged.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ticketflow.session import cut_lineage
from .common import prepare

SHARD_ROWS = 16_384   # nodes of a graph: some tens of megabytes with 64 dimensions
QUERY_BLOCK = 16_384  # queries that meet one graph in one call, about as large as the graph
M = 16                # neighbours a node chooses and keeps on upper levels; it keeps twice as many on the lowest
EF_BUILD = 64         # candidates a node chooses from
EF_SEARCH = 128
BLOCK_CELLS = 1 << 23  # similarities held at once while a graph is built


class Graph:
    """A graph over unit vectors. ``links[l]`` is an int32 array (nodes, width),
    -1 where a slot is free."""

    def __init__(self, unit: np.ndarray, levels: np.ndarray, links: list[np.ndarray], entry: int):
        self.unit, self.levels, self.links, self.entry = unit, levels, links, entry

    def flat(self) -> np.ndarray:
        """All neighbour lists, level after level, in one array."""
        return np.concatenate([x.ravel() for x in self.links]) if self.links else np.zeros(0, np.int32)

    @classmethod
    def of_flat(cls, unit: np.ndarray, levels: np.ndarray, flat: np.ndarray, entry: int) -> "Graph":
        n, links, pos = len(unit), [], 0
        for level in range(int(levels.max()) + 1):
            width = 2 * M if level == 0 else M
            links.append(flat[pos:pos + n * width].reshape(n, width))
            pos += n * width
        return cls(unit, levels, links, entry)

    def search(self, q: np.ndarray, entries: list[int], ef: int, level: int) -> list[tuple[float, int]]:
        """The ef nearest found on a level: (similarity, node), unordered."""
        unit, links = self.unit, self.links[level]
        seen = np.zeros(len(unit), dtype=bool)
        seen[entries] = True
        sims = unit[entries] @ q
        todo = [(-s, e) for s, e in zip(sims.tolist(), entries)]
        heapq.heapify(todo)
        best = [(-d, e) for d, e in todo]
        heapq.heapify(best)
        while len(best) > ef:
            heapq.heappop(best)
        while todo:
            d, node = heapq.heappop(todo)
            if len(best) >= ef and -d < best[0][0]:
                break
            near = links[node]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            for s, x in zip((unit[near] @ q).tolist(), near.tolist()):
                if len(best) < ef:
                    heapq.heappush(best, (s, x))
                    heapq.heappush(todo, (-s, x))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, x))
                    heapq.heappush(todo, (-s, x))
        return best

    def nearest(self, q: np.ndarray, ef: int) -> list[tuple[float, int]]:
        at = [self.entry]
        for level in range(len(self.links) - 1, 0, -1):
            at = [max(self.search(q, at, 1, level))[1]]
        return self.search(q, at, ef, 0)


def _spread(unit: np.ndarray, found: list[tuple[float, int]], m: int) -> list[int]:
    """Up to m of the found nodes, nearest first, none nearer to a chosen one
    than to the new node; free places go to the nearest left out."""
    found = sorted(found, key=lambda x: (-x[0], x[1]))
    nodes = np.array([x for _, x in found])
    among = unit[nodes] @ unit[nodes].T
    chosen: list[int] = []
    for k, (s, _) in enumerate(found):
        if not chosen or among[k, chosen].max() < s:
            chosen.append(k)
            if len(chosen) == m:
                break
    if len(chosen) < m:
        chosen += [k for k in range(len(found)) if k not in set(chosen)][:m - len(chosen)]
    return [int(nodes[k]) for k in chosen]


def _nearest_among(unit: np.ndarray, nodes: np.ndarray, k: int) -> np.ndarray:
    """Each node's k most similar others among ``nodes``, most similar first, by
    blocks of a bounded number of similarities."""
    x = unit[nodes].astype(np.float32)
    k = min(k, len(nodes) - 1)
    out = np.zeros((len(nodes), k), dtype=np.int64)
    step = max(1, BLOCK_CELLS // len(nodes))
    for a in range(0, len(nodes), step):
        s = x[a:a + step] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        some = np.argpartition(-s, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(s, some, axis=1), axis=1, kind="stable")
        out[a:a + step] = np.take_along_axis(some, order, axis=1)
    return nodes[out]


def _link(unit: np.ndarray, nodes: np.ndarray, table: np.ndarray) -> None:
    """Fill a level's neighbour lists: of its candidates each node chooses up to M,
    which link back; a list that gets too long keeps a spread choice."""
    width = table.shape[1]
    if len(nodes) < 2:
        return
    wanted: dict[int, list[int]] = {int(x): [] for x in nodes}
    for x, near in zip(nodes.tolist(), _nearest_among(unit, nodes, EF_BUILD)):
        chosen = _spread(unit, list(zip((unit[near] @ unit[x]).tolist(), near.tolist())), M)
        wanted[x] += chosen
        for y in chosen:
            wanted[y].append(x)
    for x, some in wanted.items():
        some = list(dict.fromkeys(some))
        if len(some) > width:
            some = _spread(unit, list(zip((unit[some] @ unit[x]).tolist(), some)), width)
        table[x, :len(some)] = some


def _reached(table: np.ndarray, entry: int) -> np.ndarray:
    seen = np.zeros(len(table), dtype=bool)
    seen[entry] = True
    front = np.array([entry])
    while len(front):
        near = np.unique(table[front])
        near = near[near >= 0]
        front = near[~seen[near]]
        seen[front] = True
    return seen


def _connect(unit: np.ndarray, nodes: np.ndarray, table: np.ndarray, entry: int) -> None:
    """Link what the entry doesn't reach, island by island, to its nearest node
    that the entry reaches and that has room or a link to spare: no node of the
    level stays out of a search's way."""
    pinned: set[tuple[int, int]] = set()  # links made here, which stay
    while True:
        seen = _reached(table, entry)
        out = nodes[~seen[nodes]]
        if not len(out):
            return
        x, inside = int(out[0]), nodes[seen[nodes]]
        for y in inside[np.argsort(-(unit[inside] @ unit[x]), kind="stable")].tolist():
            places = [k for k in range(table.shape[1]) if table[y, k] < 0 or (y, int(table[y, k])) not in pinned]
            if places:
                break
        free = [k for k in places if table[y, k] < 0]
        table[y, free[0] if free else places[-1]] = x
        pinned.add((y, x))


def build(vectors: np.ndarray, seed: int = 42) -> Graph:
    """The graph over the rows of ``vectors`` (no zero rows).

    All nodes are known, so a level's candidates are its exact nearest nodes,
    found by blocks of one matrix product, instead of those that an insertion
    one by one would meet.
    """
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    n = len(unit)
    rng = np.random.default_rng(seed)
    levels = np.minimum((-np.log(1.0 - rng.random(n)) / math.log(M)).astype(np.int64), 8)
    links = [np.full((n, 2 * M if level == 0 else M), -1, dtype=np.int32) for level in range(int(levels.max()) + 1)]
    entry = int(np.nonzero(levels == levels.max())[0][0])
    for level, table in enumerate(links):
        nodes = np.nonzero(levels >= level)[0]
        _link(unit, nodes, table)
        _connect(unit, nodes, table, entry)
    return Graph(unit, levels, links, entry)


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of one vector with the rows of another array, in double precision.
    Vectors whose squares would leave its range are scaled by a power of two first."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    most, least = np.abs(b).max(initial=0.0), np.abs(b).max(axis=1, initial=0.0).min(initial=1.0)
    if not (1e-100 < min(least, np.abs(a).max()) and max(most, np.abs(a).max()) < 1e100):
        a = a / 2.0 ** np.floor(np.log2(np.abs(a).max()))
        b = b / 2.0 ** np.floor(np.log2(np.abs(b).max(axis=1, keepdims=True)))
    return (b * a).sum(axis=1) / (np.sqrt((b * b).sum(axis=1)) * np.sqrt((a * a).sum()))


def valid_vectors(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with an id and a finite vector that isn't zero."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
            .where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)))


def build_index(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: shard, dim, ids (k + 1 least per node, -1 beyond),
    vectors, levels, neighbours (flat arrays), entry."""
    prepare(vectors.sparkSession)
    # equal rows count once, so that copies don't fill the places of other ids;
    # rows of one vector beyond the k + 1 least ids are cut before the shuffle (partial rank limit)
    least = Window.partitionBy("v").orderBy("id")
    nodes = cut_lineage(vectors.distinct().withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= k + 1)
                        .groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")))
    shards = max(1, math.ceil(nodes.count() / shard_rows))
    width = k + 1

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(first=[x[0] for x in pdf["ids"]]).sort_values(["dim", "first"])
        out = []
        for dim, own in pdf.groupby("dim", sort=True):
            x = np.stack(own["v"].to_numpy()).astype(np.float64)
            g = build(x)
            ids = np.full((len(x), width), -1, dtype=np.int64)
            for row, some in enumerate(own["ids"]):
                ids[row, :min(width, len(some))] = np.asarray(some)[:width]
            out.append({"shard": int(own["shard"].iloc[0]), "dim": int(dim), "n": len(x), "ids": ids.ravel(), "vectors": x.ravel(),
                        "levels": g.levels.astype(np.int32), "neighbours": g.flat(), "entry": int(g.entry)})
        return pd.DataFrame(out)

    return cut_lineage(nodes.select(F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), F.size("v").alias("dim"), "v", "ids")
                       .repartition(shards, "shard").groupBy("shard").applyInPandas(
        index, "shard int, dim int, n int, ids array<long>, vectors array<double>, levels array<int>, neighbours array<int>, entry int"))


def search(embeddings: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
           shard_rows: int = SHARD_ROWS, ef: int = EF_SEARCH) -> DataFrame:
    """For each row whose id is divisible by ``every``: its k nearest other rows
    found, by cosine, nearest first, ties to smaller ids: query_id, rank,
    vec_id, score.

    Rows with a null id, or a vector that is null, empty, zero or has null or
    non-finite components, take no part. Vectors of another length than the
    query's are not its candidates. A row that occurs twice counts once; rows
    that share an id with different vectors are all indexed, none is a candidate
    for a query of that id, and such a query is made from the least vector.
    Fewer candidates than k are all given; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    vectors = valid_vectors(embeddings, id_col, vector_col)
    index = build_index(vectors, k, shard_rows)
    queries = cut_lineage(vectors.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
                          .select("id", "v", F.size("v").alias("dim")))
    # a block is one row of queries, met by every shard's index row; few shards meet more, smaller blocks
    asked, shards = queries.count(), index.count()
    spread = min(math.ceil(asked / 64), math.ceil(spark.sparkContext.defaultParallelism / max(1, shards)))
    blocks = max(1, math.ceil(asked / QUERY_BLOCK), spread)
    blocked = (queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
               .groupBy("dim", "block").agg(F.collect_list(F.struct("id", "v")).alias("queries")))
    pairs = (index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(blocked, ["dim", "block"])
             .repartition(max(1, min(shards * blocks, 1 << 15)), "shard", "block"))

    def find(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x = np.asarray(r.vectors).reshape(r.n, r.dim)
                ids = np.asarray(r.ids).reshape(r.n, k + 1)
                scaled = x / np.abs(x).max(axis=1, keepdims=True)
                unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
                g = Graph.of_flat(unit, np.asarray(r.levels), np.asarray(r.neighbours), r.entry)
                out = []
                for one in r.queries:
                    qid, q = one["id"], np.asarray(one["v"], dtype=np.float64)
                    direction = q / np.abs(q).max()
                    nodes = np.array(sorted(e for _, e in g.nearest(direction / np.linalg.norm(direction), ef)))
                    scores = exact_cosine(q, x[nodes])
                    mine = [(-s, int(i), qid) for s, row in zip(scores.tolist(), ids[nodes]) for i in row if i >= 0 and i != qid]
                    out += heapq.nsmallest(k, mine)
                yield pd.DataFrame([(q, i, -s) for s, i, q in out], columns=["query_id", "vec_id", "score"])

    def one_at_a_time(batches):
        """Index rows are large; each is searched before the next is unpacked."""
        yield from find(b.iloc[j:j + 1] for b in batches for j in range(len(b)))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (pairs.mapInPandas(one_at_a_time, "query_id long, vec_id long, score double")
            .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
