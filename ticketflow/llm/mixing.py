"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted once into cells (source, language, topic). Raking scales
the cells' token mass until its source, language and topic marginals meet their
targets. A cell's ratio of raked to observed mass gives the probability with
which each of its documents is kept, scaled so that the expected kept mass is a
given share of the whole. Raking holds every cell to a probability of at most 1;
where that can't meet the targets at the given share, either the targets or the
share come first.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ticketflow.session import cut_lineage, stage, unstage
from .common import Staged, fresh, prepare, text_bytes

TOPICS = 8
DIMS = 512           # of the hashed vectors that topics are found by
TOPIC_ROUNDS = 20
PACKED = ["at", "runs", "values"]  # columns of ``_packed``
UNIT = 1 << 30   # steps of a component in the sums of vectors, which are whole numbers: the same in any order
DRIVER_CELLS = 200_000
SWEEPS = 200     # after which raking also ends when a further 100 sweeps halve its movement no more: the targets can't be met
TOLERANCE = 1e-9
MISS = 1e-6      # a marginal this near its target meets it
HALVINGS = 8     # of the interval in which the largest possible share to keep is sought
NEARLY = 0.97    # of the share to keep that is enough where the targets come first
PULLS = (1.0, 0.75, 0.5, 0.25, 0.0)  # of the way from the observed marginals to the powers asked for
HUGE = 1e100     # where scales stop that a bound keeps from their target


class Topics:
    """Topics of texts: the nearest of some directions of hashed TF-IDF vectors."""

    def __init__(self, idf: np.ndarray, centres: np.ndarray):
        self.idf, self.centres = idf, centres

    @staticmethod
    def counts(words: list[bytes]) -> np.ndarray:
        """log(1 + occurrences) of a text's words, added up by the CRC-32 of the word modulo the dimensions."""
        n = Counter(words)
        at = np.fromiter(map(crc32, n), dtype=np.int64, count=len(n)) % DIMS
        return np.bincount(at, np.log1p(np.fromiter(n.values(), dtype=float, count=len(n))), DIMS)

    def nearest(self, counts: np.ndarray) -> int:
        """The topic of a text by its counts."""
        return int((self.centres @ (counts * self.idf)).argmax()) if len(self.centres) else 0

    def of(self, data: bytes) -> tuple[int, int]:
        """(words, topic) of a text; ties and texts without words go to the least topic."""
        words = data.lower().split()
        return len(words), self.nearest(self.counts(words)) if words else 0


def _packed(counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """A vector's places other than zero by their value, at how many of them each value stands, and the values."""
    at = counts.nonzero()[0]
    value = counts[at]
    order = value.argsort(kind="stable")
    value = value[order]
    last = np.ones(len(at), dtype=bool)
    np.not_equal(value[1:], value[:-1], out=last[:-1])
    ends = np.concatenate([[-1], last.nonzero()[0]])
    return at[order].astype("<u2").tobytes(), (ends[1:] - ends[:-1]).astype("<u2").tobytes(), value[last].tobytes()


def _entries(at: pa.Array, runs: pa.Array, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of the entries of packed vectors, row by row."""
    def joined(a: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
        a = a.cast(pa.large_binary())
        ends = np.frombuffer(a.buffers()[1], "<i8")[a.offset:a.offset + len(a) + 1] // np.dtype(kind).itemsize
        return np.frombuffer(a.buffers()[2], kind, ends[-1])[ends[0]:], ends[1:] - ends[:-1]

    places, sizes = joined(at, "<u2")
    return np.repeat(np.arange(len(at)), sizes), places.astype(np.int64), np.repeat(joined(values, "<f8")[0], joined(runs, "<u2")[0])


def _unpacked(v: tuple) -> np.ndarray:
    out = np.zeros(DIMS)
    if len(v):
        at, runs, values = v
        out[np.frombuffer(at, "<u2")] = np.repeat(np.frombuffer(values, "<f8"), np.frombuffer(runs, "<u2"))
    return out


def _vectors(docs: DataFrame, text_col: str, *others: str) -> DataFrame:
    """(others, h, s, mass, at, runs, values), staged: two hashes of the text, its words
    and an end token, and its packed counts. Texts are read once for the topics and the cells."""
    @F.pandas_udf("mass long, at binary, runs binary, values binary")
    def of(s: pd.Series) -> pd.DataFrame:
        words = [bytes(x).lower().split() for x in s]
        return pd.DataFrame([(len(w) + 1, *_packed(Topics.counts(w))) for w in words], columns=["mass", *PACKED])

    data = docs.select(*others, text_bytes(text_col).alias("_data"))
    made = data.select(*others, F.xxhash64("_data").alias("h"), F.sha2("_data", 256).alias("s"), of.asNondeterministic()("_data").alias("a"))
    return stage(made.select(*others, "h", "s", "a.*"))


def fit_topics(docs: DataFrame, text_col: str, topics: int = TOPICS) -> Topics:
    """Directions fitted on all different texts: spherical k-means, started from
    the texts of the least hashes."""
    prepare(docs.sparkSession)
    vectors = _vectors(docs, text_col)
    out = _fit(vectors, topics)
    unstage(vectors)
    return out


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns.values()], list(columns))


def _fit(vectors: DataFrame, topics: int) -> Topics:
    """``fit_topics`` from the table of ``_vectors``: each round is a pass of Spark
    over the different texts' vectors, of which the driver gets the sums."""
    # one vector per text; copies are combined before the exchange
    once = stage(vectors.where(F.length("at") > 0).groupBy("h", "s").agg(F.first(F.struct(*PACKED)).alias("v")).select("h", "s", "v.*"))

    def occurrences(batches):
        n, total = np.zeros(DIMS, dtype=np.int64), 0
        for batch in batches:
            if len(batch):
                n += np.bincount(_entries(*(batch[c] for c in PACKED))[1], minlength=DIMS)
                total += len(batch)
        yield _batch(at=np.arange(-1, DIMS), n=np.concatenate([[total], n]))

    def added(df: DataFrame, *by: str) -> dict:
        return {tuple(r[c] for c in by): r["n"] for r in df.groupBy(*by).agg(F.sum("n").alias("n")).collect()}

    found = added(once.select(*PACKED).mapInArrow(occurrences, "at long, n long"), "at")
    texts = found.get((-1,), 0)
    idf = np.log((1 + texts) / (1 + np.array([found.get((k,), 0) for k in range(DIMS)])))

    def units(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, value) of a batch's unit vectors; a text of nothing but words that all texts have has none."""
        row, at, value = _entries(*(batch[c] for c in PACKED))
        value *= idf[at]
        norm = np.sqrt(np.bincount(row, value * value, len(batch)))
        if not norm.all():
            some = norm[row] > 0
            row, at, value = row[some], at[some], value[some]
        return row, at, value / norm[row]

    def first(batches):
        best: list = []
        for batch in batches:
            if len(batch):
                row, at, value = units(batch)
                h, have = batch["h"].to_numpy(), np.unique(row)
                if len(have) > topics:  # and those of equal hashes
                    have = have[h[have] <= np.partition(h[have], topics - 1)[topics - 1]]
                for r in have.tolist():
                    x = np.zeros(DIMS)
                    x[at[row == r]] = value[row == r]
                    best.append((int(h[r]), batch["s"][r].as_py(), x.tolist()))
                best = sorted(best, key=lambda e: e[:2])[:topics]
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in best], t) for k, t in enumerate((pa.int64(), pa.string(), pa.list_(pa.float64())))], ["h", "s", "x"])

    start = once.mapInArrow(first, "h long, s string, x array<double>").orderBy("h", "s").limit(topics).collect()
    centres = np.array([r["x"] for r in start]).reshape(-1, DIMS)
    for _ in range(TOPIC_ROUNDS if len(centres) else 0):
        def assign(batches, centres=centres):
            sums, room = np.zeros(len(centres) * DIMS, dtype=np.int64), np.zeros((0, DIMS))
            for batch in batches:
                if len(batch):
                    row, at, value = units(batch)
                    room = room if len(room) >= len(batch) else np.zeros((len(batch), DIMS))
                    room[row, at] = value
                    of = np.round(room[:len(batch)] @ centres.T, 12).argmax(axis=1)
                    room[row, at] = 0
                    sums += np.bincount(of[row] * DIMS + at, np.rint(value * UNIT), len(sums)).astype(np.int64)
            some = np.flatnonzero(sums)
            yield _batch(topic=some // DIMS, at=some % DIMS, n=sums[some])

        sums = np.zeros(centres.shape)
        for (topic, at), n in added(once.select(*PACKED).mapInArrow(assign, "topic long, at long, n long"), "topic", "at").items():
            sums[topic, at] = n
        moved = np.where(sums.any(axis=1, keepdims=True), sums, centres)
        moved = moved / np.linalg.norm(moved, axis=1, keepdims=True)
        if np.array_equal(moved, centres):
            break
        centres = moved
    unstage(once)
    return Topics(idf, centres)


def _topic_of(topics: Topics) -> Column:
    """The topic of a text by its packed counts."""
    @F.pandas_udf("int")
    def of(at: pd.Series, runs: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([topics.nearest(_unpacked(v)) if len(v[0]) else 0 for v in zip(at, runs, values)], dtype="int32")
    return of.asNondeterministic()(*PACKED)


def describe_column(data: Column, topics: Topics) -> Column:
    """struct(mass, topic): words and one end-of-document token, so that an
    empty document weighs 1."""
    @F.pandas_udf("mass long, topic int")
    def of(s: pd.Series) -> pd.DataFrame:
        got = [topics.of(bytes(x)) for x in s]
        return pd.DataFrame({"mass": [n + 1 for n, _ in got], "topic": [t for _, t in got]})
    return of.asNondeterministic()(data)


def tempered(cells: DataFrame, col: str, power: float, keep: float | None = None) -> DataFrame:
    """(col, share): targets in proportion to the observed mass to a power; 1
    leaves the marginal as it is, 0 makes it even.

    With ``keep``, no category is asked for more than it has where that share of
    the whole is kept (its observed share / keep): what it can't give, the others
    give in proportion. Else one rare category would decide how little is kept.
    """
    by = cut_lineage(cells.groupBy(col).agg(F.sum("mass").cast("double").alias("m")))
    mass, tilted = by.agg(F.sum("m"), F.sum(F.pow("m", F.lit(power)))).first()
    if not mass:
        return by.select(col, F.lit(0.0).alias("share"))
    by = by.select(col, (F.pow("m", F.lit(power)) / F.lit(tilted)).alias("share"), (F.col("m") / F.lit(mass * (keep or 1.0))).alias("most"))
    scale = 1.0
    while keep:
        full = F.col("share") * F.lit(scale) >= F.col("most")
        held, free = by.agg(F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("share"))), F.lit(0.0))).first()
        raised = (1 - held) / free if free > 0 and held < 1 else scale
        if raised <= scale * (1 + 1e-12):
            return by.select(col, F.least(F.col("share") * F.lit(scale), F.col("most")).alias("share"))
        scale = raised
    return by.select(col, "share")


def _goes_on(moves: list[float]) -> bool:
    """Whether raking goes on, from how far each sweep moved the shares."""
    if not moves:
        return True
    stuck = len(moves) >= SWEEPS and moves[-1] > moves[-100] / 2
    return moves[-1] >= TOLERANCE and not stuck


def _rake_numpy(mass: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], keep: float | None = None) -> tuple[np.ndarray, float]:
    """(raked shares of the cells, the most by which a marginal misses its
    target). With ``keep``, no cell's share passes its observed share / keep,
    so that keep * ratio is a probability: a category's free cells are scaled
    to what its cells at the bound leave of the target."""
    x = mass / mass.sum()
    bound = x / keep if keep else np.full(len(x), np.inf)
    w = np.minimum(x, bound)
    moves: list[float] = []
    while _goes_on(moves):
        before = w
        for code, target in zip(codes, targets):
            n, free = len(target), x < bound
            whole = np.bincount(code, weights=x, minlength=n)
            loose = np.bincount(code, weights=np.where(free, x, 0.0), minlength=n)
            held = np.bincount(code, weights=np.where(free, 0.0, bound), minlength=n)
            plain = np.divide(target, whole, out=np.zeros(n), where=whole > 0)
            f = np.divide(target - held, loose, out=np.where(held < target, 1.0, plain), where=(loose > 0) & (held < target))
            x = np.minimum(x * np.where(whole > 0, f, 0.0)[code], HUGE)
        w = np.minimum(x, bound)
        moves.append(float(np.abs(w - before).sum()))
    return w, max(float(np.abs(np.bincount(c, weights=w, minlength=len(t)) - t).max()) for c, t in zip(codes, targets))


def _scale_numpy(mass: np.ndarray, ratio: np.ndarray, wanted: float) -> float:
    """s with sum(mass * min(1, s * ratio)) = wanted, exactly: the cells reach 1
    in order of their ratio."""
    order = np.argsort(-ratio, kind="stable")
    m, r = mass[order].astype(float), ratio[order]
    full = np.concatenate([[0.0], np.cumsum(m)])     # mass of the cells at 1
    rest = np.concatenate([np.cumsum((m * r)[::-1])[::-1], [0.0]])
    for k in range(len(m)):  # the first k cells at 1
        if rest[k] <= 0:
            break
        s = (wanted - full[k]) / rest[k]
        if s * r[k] <= 1:
            return max(s, 0.0)
    return float("inf")


def _largest(low: float, high: float, fits):
    """What ``fits`` gives for the largest share found between ``low``, which
    needs no bound, and ``high``: (share, result), result None for ``low``."""
    got = fits(high)
    if got is not None:
        return high, got
    best = low, None
    for _ in range(HALVINGS):
        mid = (low + high) / 2
        got = fits(mid)
        if got is None:
            high = mid
        else:
            low, best = mid, (mid, got)
    return best


def rake_cells(cells: DataFrame, margins: dict[str, DataFrame], keep: float, driver_cells: int = DRIVER_CELLS,
               targets_first: bool = False) -> DataFrame:
    """``cells`` (the margins' columns, mass) with ratio, probability and miss: the
    most by which the expected share of a category in what is kept is off its target.

    ``margins`` maps a column to its targets (column, share); nulls are a
    category of their own. Up to ``driver_cells`` cells, counted first, are
    raked in numpy; more are raked by joins, each sweep written to the shared folder.

    Cells that would need a probability above 1 are raked under that bound, so
    that the expected kept shares meet the targets. Where no probabilities give
    both the targets and ``keep`` (a category's target is above its share /
    keep, say), ``targets_first`` keeps less, the largest share found that meets
    the targets; without it the share is kept and the targets are missed.
    """
    spark, names = cells.sparkSession, list(margins)
    if cells.count() > driver_cells:
        out = cut_lineage(_rake_joins(cells, margins, keep, targets_first))
        kept = out.agg(F.sum(F.col("mass") * F.col("probability"))).first()[0] or 1.0
        miss = 0.0
        for c, target in margins.items():
            t = target.select(F.col(c).alias("_c"), "share")
            off = (out.groupBy(F.struct(c).alias("_k")).agg(F.sum(F.col("mass") * F.col("probability")).alias("m")).select(F.col(f"_k.{c}").alias("_m"), "m")
                   .join(t, F.col("_m").eqNullSafe(F.col("_c"))).agg(F.max(F.abs(F.col("m") / F.lit(kept) - F.col("share")))).first()[0])
            miss = max(miss, off or 0.0)
        return out.withColumn("miss", F.lit(miss))
    got = cells.toPandas()
    if not len(got):
        return cells.select(*names, "mass", F.lit(1.0).alias("ratio"), F.lit(1.0).alias("probability"), F.lit(0.0).alias("miss"))
    mass = got["mass"].to_numpy(dtype=float)
    codes, targets = [], []
    for c in names:
        share = {k: v for k, v in ((r[c], r["share"]) for r in margins[c].collect())}
        keys = {k: i for i, k in enumerate(share)}
        codes.append(np.array([keys[None if pd.isna(x) else x] for x in got[c]]))
        targets.append(np.array(list(share.values()), dtype=float))
    observed = mass / mass.sum()
    w, miss = _rake_numpy(mass, codes, targets)
    ratio = w / observed

    def fits(k: float):
        bounded, off = _rake_numpy(mass, codes, targets, k)
        return bounded / observed if off <= miss + MISS else None

    scale, free = keep, 1 / ratio.max()
    if keep > free:
        if targets_first:
            most = min(float((np.bincount(c, weights=observed, minlength=len(t))[t > 0] / t[t > 0]).min()) for c, t in zip(codes, targets))
            scale, bounded = _largest(free, max(free, min(keep, most)), fits)
        else:
            bounded = fits(keep)
        if bounded is not None:
            ratio = bounded
        elif not targets_first:
            scale = _scale_numpy(mass, ratio, keep * mass.sum())
    p = np.minimum(1.0, np.nan_to_num(scale * ratio, nan=0.0, posinf=1.0))
    kept = mass * p / max(float((mass * p).sum()), 1e-300)
    off = max(float(np.abs(np.bincount(c, weights=kept, minlength=len(t)) - t).max()) for c, t in zip(codes, targets))
    rows = [(*[None if pd.isna(got[c][i]) else got[c][i].item() if hasattr(got[c][i], "item") else got[c][i] for c in names],
             int(mass[i]), float(ratio[i]), float(p[i]), off) for i in range(len(got))]
    kinds = dict(cells.dtypes)
    return spark.createDataFrame(rows, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "mass long", "ratio double", "probability double", "miss double"]))


def _sweep_joins(cells: DataFrame, margins: dict[str, DataFrame], keep: float | None = None) -> tuple[DataFrame, float]:
    """``_rake_numpy`` by joins, over cells with their observed share (_o) and targets (_t_...)."""
    stage = Staged(cells.sparkSession)
    bound = F.col("_o") / F.lit(keep) if keep else F.lit(float("inf"))
    w = F.least(F.col("x"), bound)
    now = cells.withColumn("x", F.col("_o")).withColumn("before", w)
    moves: list[float] = []
    while _goes_on(moves):
        for c in margins:
            # grouped by a wrapped key, so that the join can split a category with very many cells
            sums = (now.groupBy(F.struct(c).alias("_k"))
                    .agg(F.sum("x").alias("_whole"), F.sum(F.when(F.col("x") < bound, F.col("x")).otherwise(0.0)).alias("_loose"),
                         F.sum(F.when(F.col("x") < bound, 0.0).otherwise(bound)).alias("_held"))
                    .select(F.col(f"_k.{c}").alias("_c"), "_whole", "_loose", "_held"))
            t = F.col(f"_t_{c}")
            f = (F.when(F.col("_whole") <= 0, 0.0).when(F.col("_held") >= t, t / F.col("_whole"))
                 .when(F.col("_loose") > 0, (t - F.col("_held")) / F.col("_loose")).otherwise(1.0))
            now = (now.join(sums, F.col(c).eqNullSafe(F.col("_c")))
                   .withColumn("x", F.least(F.col("x") * f, F.lit(HUGE))).drop("_c", "_whole", "_loose", "_held"))
        now = stage.put(now)
        moves.append(now.agg(F.sum(F.abs(w - F.col("before")))).first()[0])
        now = now.withColumn("before", w)
    now = now.withColumn("w", w)
    miss = max(now.groupBy(F.struct(c).alias("_k")).agg((F.sum("w") - F.max(f"_t_{c}")).alias("d"))
               .agg(F.max(F.abs("d"))).first()[0] for c in margins)
    return now.select(*margins, "mass", (F.col("w") / F.col("_o")).alias("ratio")), miss


def _rake_joins(cells: DataFrame, margins: dict[str, DataFrame], keep: float, targets_first: bool) -> DataFrame:
    total = cells.agg(F.sum("mass").cast("double")).first()[0]
    base = cells
    for c, target in margins.items():  # each cell carries its targets
        t = target.select(F.col(c).alias("_c"), F.col("share").alias(f"_t_{c}"))
        base = base.join(t, F.col(c).eqNullSafe(F.col("_c"))).drop("_c")
    base = cut_lineage(base.withColumn("_o", F.col("mass") / F.lit(total)))
    now, miss = _sweep_joins(base, margins)
    now = cut_lineage(now)

    def fits(k: float):
        bounded, off = _sweep_joins(base, margins, k)
        return bounded if off <= miss + MISS else None

    free = 1 / now.agg(F.max("ratio")).first()[0]
    if keep <= free:
        return now.withColumn("probability", F.least(F.lit(1.0), F.lit(keep) * F.col("ratio")))
    if targets_first:
        most = min(base.groupBy(F.struct(c).alias("_k")).agg((F.sum("_o") / F.max(f"_t_{c}")).alias("m")).agg(F.min("m")).first()[0] for c in margins)
        scale, bounded = _largest(free, max(free, min(keep, most)), fits)
    else:
        scale, bounded = keep, fits(keep)
    if bounded is not None or targets_first:
        out = now if bounded is None else cut_lineage(bounded)
        return out.withColumn("probability", F.least(F.lit(1.0), F.lit(scale) * F.col("ratio")))
    low, high = 0.0, now.agg(F.max(1 / F.when(F.col("ratio") > 0, F.col("ratio")))).first()[0] or 1.0
    for _ in range(12):  # 32 scales a job; the interval shrinks 31-fold each time
        tries = [low + (high - low) * k / 31 for k in range(32)]
        got = now.agg(*[F.sum(F.col("mass") * F.least(F.lit(1.0), F.lit(s) * F.col("ratio"))).alias(f"s{k}") for k, s in enumerate(tries)]).first()
        under = [s for k, s in enumerate(tries) if got[k] <= keep * total]
        over = [s for k, s in enumerate(tries) if got[k] > keep * total]
        low, high = max(under, default=low), min(over, default=high)
        if not over:
            low = high
            break
    return now.withColumn("probability", F.least(F.lit(1.0), F.lit(low) * F.col("ratio")))


def _raked(described: DataFrame, powers: tuple, keep: float, targets_first: bool) -> DataFrame:
    """(k, a struct of source, lang and topic; cell, one of ratio, probability and
    miss) from rows (source, lang, topic, mass), marked for broadcast if few."""
    cells = cut_lineage(described.groupBy("source", "lang", "topic").agg(F.sum("mass").alias("mass")))
    for pull in PULLS if targets_first else PULLS[:1]:
        margins = {c: tempered(cells, c, 1 - (1 - p) * pull, keep) for c, p in zip(("source", "lang", "topic"), powers)}
        raked = rake_cells(cells, margins, keep, targets_first=targets_first)
        kept = raked.agg(F.sum(F.col("mass") * F.col("probability")) / F.sum("mass")).first()[0]
        if kept is None or kept >= NEARLY * keep:
            break
    raked = cut_lineage(raked.select(F.struct("source", "lang", "topic").alias("k"), F.struct("ratio", "probability", "miss").alias("cell")))
    return F.broadcast(raked) if raked.count() <= DRIVER_CELLS else raked


def uniform(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) from a hash of the columns: the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
        powers: tuple = (0.5, 0.7, 0.5), keep: float = 0.6, seed: int = 42,
        targets_first: bool = False) -> DataFrame:
    """One row per document: id, source, lang, topic, n_tokens (words between white
    space and one end token), weight (raked to observed mass of its cell),
    probability, kept, target_miss (the most by which the expected share of a
    category in what is kept is off its target: above 1e-6 they can't all be met).
    Topics are clusters of hashed TF-IDF vectors, see ``fit_topics``.

    The targets are the observed marginals to ``powers`` (source, language,
    topic), none above what a category has at the share kept. ``keep`` is the
    expected share of the mass that is kept. Sources, languages and topics that
    go together may not allow all targets at that share; with ``targets_first``
    the powers are then drawn towards 1, the observed marginals, in the steps of
    ``PULLS``, until at least 97 % of that share meets them. Null sources and languages are categories of their own; null and
    empty texts weigh 1 and have the least topic. Rows equal in id and text are
    kept or not together. An empty table gives no rows; other columns are not read.
    The result reads a table in the shared checkpoint folder that stays there.
    """
    prepare(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"))
    vectors = _vectors(d.withColumn("_u", uniform(seed, F.col("_id"), F.col("_text"))), "_text", "_id", "source", "lang", "_u")
    topics = _fit(vectors, TOPICS)
    # without texts and vectors: what is left of a document for its cell and its row
    described = stage(vectors.select("_id", "source", "lang", "_u", "mass", _topic_of(topics).alias("topic")))
    unstage(vectors)
    out = described.join(_raked(described, powers, keep, targets_first), F.struct("source", "lang", "topic").eqNullSafe(F.col("k")))
    p = F.col("cell.probability")
    return out.select(F.col("_id").alias(docs.select(F.col(id_col)).columns[0]), "source", "lang", "topic", F.col("mass").alias("n_tokens"),
                      F.col("cell.ratio").alias("weight"), p.alias("probability"),
                      (F.col("_u") < p).alias("kept"), F.col("cell.miss").alias("target_miss"))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
           powers: tuple = (0.5, 0.7, 0.5), keep: float = 0.6, seed: int = 42,
           targets_first: bool = False) -> DataFrame:
    """The documents that ``mix`` keeps, with all their columns."""
    prepare(docs.sparkSession)
    d = docs.select(F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), F.col(text_col).alias("_text"))
    vectors = _vectors(d, "_text", "source", "lang")
    topics = _fit(vectors, TOPICS)
    raked = _raked(vectors.select("source", "lang", "mass", _topic_of(topics).alias("topic")), powers, keep, targets_first)
    unstage(vectors)
    topic, k, cell = (fresh(docs, c) for c in ("_topic", "_k", "_cell"))
    raked = raked.withColumnsRenamed({"k": k, "cell": cell})
    key = F.struct(F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), F.col(f"{topic}.topic").alias("topic"))
    out = docs.withColumn(topic, describe_column(text_bytes(text_col), topics)).join(raked, key.eqNullSafe(F.col(k)))
    return (out.where(uniform(seed, F.col(id_col), F.col(text_col)) < F.col(f"{cell}.probability"))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
