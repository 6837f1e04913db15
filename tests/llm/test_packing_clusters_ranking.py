"""Packing, centroid clustering, ranked search; row identity on derived frames."""

import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F, types as T
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fixtures import SCHEMA, SF, awkward, awkward_rows, empty, prose  # noqa: E402
from ticketflow.llm import ball_tree, centroids, encoding, packing, sharding, simhash, token_count, warc  # noqa: E402
from ticketflow.llm.common import with_row_id  # noqa: E402

VOCAB = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCAB)


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


# ---------------------------------------------------------------- encoding

def test_encoder_equals_the_tokenizer(tokenizer, monkeypatch):
    with open(VOCAB, "rb") as f:
        enc = encoding.TextEncoder(f.read())
    rng = random.Random(8)
    letters = "ab Z09 \n  's'll,.!é×ÀÿĀɏɐ😀中\t\x00\xa0ǅʰª_"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(20_000)]
    texts += [t + "<|endoftext|>" + t[:4] for t in texts[:500]] + ["", " ", "\n", "x" * 5000, " " * 300, prose(rng, 500)]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
    monkeypatch.setattr(encoding, "SLICE", 20)  # long texts go slice by slice
    monkeypatch.setattr(encoding, "REMEMBERED", 50)
    for t in texts[:3000]:
        t = t * 8
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


# ---------------------------------------------------------------- packing

def test_first_fit_decreasing_against_a_scan():
    rng = random.Random(2)
    for _ in range(200):
        sizes = sorted((rng.randint(1, 64) for _ in range(rng.randint(0, 60))), reverse=True)
        free, want = [], []
        for s in sizes:
            k = next((k for k, f in enumerate(free) if f >= s), len(free))
            if k == len(free):
                free.append(64)
            free[k] -= s
            want.append(k)
        assert packing.first_fit_decreasing(sizes, 64) == want


def test_fill_up_keeps_every_id():
    rng = random.Random(3)
    for _ in range(200):
        bins = [[[k, 0, rng.randint(1, 64)]] for k in range(rng.randint(0, 30))]
        want = {b[0][0]: b[0][2] for b in bins}
        got = packing.fill_up(bins, 64, 4)
        seen = defaultdict(list)
        for b in got:
            assert 0 < sum(p[2] for p in b) <= 64
            for k, start, n in b:
                assert n > 0
                seen[k].append((start, n))
        for k, n in want.items():
            at = 0
            for start, m in sorted(seen[k]):
                assert start == at
                at += m
            assert at == n
        assert sum(packing.padding(sum(p[2] for p in b), 64) > 4 for b in got) <= 1


def check_packing(rows, docs, tokenizer, capacity=1024):
    """Pieces hold each id of each document once, and sequences have no gaps."""
    want = Counter()
    by_id = defaultdict(list)
    for doc_id, text in docs:
        ids = ids_of(tokenizer, text)
        by_id[doc_id].append(ids)
        want[doc_id] += len(ids)
    got, seqs = Counter(), defaultdict(list)
    for r in rows:
        got[r["doc_id"]] += r["length"]
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        assert any(len(ids) == r["doc_tokens"] and zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
                   for ids in by_id[r["doc_id"]])
    assert got == want
    for doc_id, some in by_id.items():  # with one document of the id: from start to end without a gap
        if len(some) == 1:
            at = 0
            for r in sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: r["start"]):
                assert r["start"] == at
                at += r["length"]
            assert at == len(some[0])
    pad = 0
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert 0 < at <= capacity
        pad += packing.padding(at, capacity)
    return pad / max(1, sum(want.values()))


def test_packing_of_awkward_rows(spark, tokenizer):
    out = packing.pack(awkward(spark), VOCAB, group_rows=20).collect()
    check_packing(out, [(r[0], r[1]) for r in awkward_rows()], tokenizer)
    assert packing.pack(empty(spark), VOCAB).count() == 0
    named = awkward(spark).select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), F.col("text").alias("length"))
    assert {r["id"] for r in packing.pack(named, VOCAB, "id", "length").collect()} == {None if r[0] is None else f"d{r[0]}" for r in awkward_rows()}


def test_packing_of_equal_lengths_leaves_little_padding(spark, tokenizer):
    """A third of the rows share one length over half a sequence."""
    rng = random.Random(4)
    texts = [prose(rng, 260)] * 60 + [prose(rng, rng.randint(1, 700)) for _ in range(120)]
    rows = [(k, t, "en", "a", 0, *["x"] * 9) for k, t in enumerate(texts)]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA), VOCAB).collect()
    assert check_packing(out, list(enumerate(texts)), tokenizer) < 0.02


def test_packing_of_the_documents_table(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert check_packing(packing.pack(docs, VOCAB).collect(), rows, tokenizer) < 0.02


# ---------------------------------------------------------------- centroid clustering

def slow_clusters(rows, clusters=8, rounds=10, dims=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) * 1024 < 2.0 ** 60 for x in v):
            kept.append((i, [math.floor(x * 1024) for x in v]))
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=key)[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, x), k) for k, x in enumerate(c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        c = [[sum(x) // len(own[k]) for x in zip(*own[k])] if own[k] else old for k, old in enumerate(c)]
    most = (1 << 63) - 1
    got = [(i, near(v)) for i, v in kept]
    inertia = Counter()
    for _, (d, k) in got:
        inertia[k] += min(d, most)
    return sorted(((i, k, min(d, most), min(inertia[k], most), min(sum(inertia.values()), most), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest())
                   for i, (d, k) in got), key=str)


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                        T.StructField("id", T.StringType()), T.StructField("q", T.StringType()), T.StructField("cluster", T.StringType())])
CLUSTER_COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clustered(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", "x", "x") for i, v in rows], VECTORS).repartition(3)
    return sorted((tuple(r[c] for c in CLUSTER_COLUMNS) for r in centroids.cluster(df, **kw).collect()), key=str)


def test_threshold_walk_against_all_distances():
    rng = np.random.default_rng(1)
    for _ in range(200):
        dims, count, n, most = int(rng.integers(1, 9)), int(rng.integers(1, 9)), int(rng.integers(0, 30)), int(rng.choice([2, 5, 1000]))
        q, c = rng.integers(-most, most + 1, (n, dims)), rng.integers(-most, most + 1, (count, dims))
        d = ((q[:, None, :] - c[None]) ** 2).sum(axis=2)
        for own in ((q, c), (q.astype(object), c.astype(object))):
            who, far = centroids.nearest(*own)
            assert who.tolist() == d.argmin(axis=1).tolist() and far.tolist() == d.min(axis=1).tolist()


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 64)) * rng.choice([0.01, 1, 3], size=(120, 1))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += rows[:3] * 2 + [(500 + k, rows[7][1]) for k in range(60)] + [(None, rows[9][1]), (None, rows[11][1])]
    bad = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [float("nan")] + [1.0] * 63), (905, [float("inf")] * 64), (906, [None] * 64),
           (907, [1e300] * 64)]
    assert clustered(spark, rows + bad) == slow_clusters(rows + bad)
    assert clustered(spark, rows[:5]) == slow_clusters(rows[:5])  # fewer vectors than clusters
    assert clustered(spark, bad) == [] and clustered(spark, []) == []


def test_clusters_of_large_components_and_ties(spark):
    rows = [(k, [float(k % 3)] * 4) for k in range(30)] + [(40, [1e9, -1e9, 1e12, 0.5]), (41, [3e14] * 4), (42, [-3e14] * 4)]
    assert clustered(spark, rows, dims=4, clusters=5) == slow_clusters(rows, dims=4, clusters=5)


# ---------------------------------------------------------------- ranked search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def slow_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_ranking(docs, items, k=20):
    words = [(i, slow_words(t)) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n_docs, total = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in sorted(set(items), key=str):
        scores = []
        for i, w in words:
            tf, m = Counter(w), 75 + 25 * len(w) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * tf[t] // (1000 * tf[t] + 12 * m))
                    for t in slow_words(text) if t in tf)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def ranked(docs, items, **kw):
    return sorted((tuple(r) for r in ball_tree.rank(docs, items, **kw).collect()), key=str)


def test_term_parts(monkeypatch):
    monkeypatch.setattr(ball_tree, "_PART", 10)
    for text in ("", " ", "Ab-c d_É x中 9\x7f!", "word " * 40, "x" * 100, "A" * 9 + " b" * 9, "\x85Ünï\tZ"):
        assert [w.decode() for part in ball_tree.term_parts(text.encode()) for w in part] == slow_words(text)


def test_ranking_against_brute_force(spark):
    rows = awkward_rows(200)
    rng = random.Random(1)
    items = [(1, rows[3][1]), (1, rows[3][1]), (1, rows[5][1]), (2, "a popular copy of many words"), (3, ""), (4, None), (5, "-- !!"), (6, "unknownword"),
             (None, rows[8][1]), (7, "no ID Here"), (8, "the same row twice the same"), (9, "É中文😀"), (10, "ba ba ba ke " * 30)]
    items += [(20 + k, prose(rng, rng.randint(1, 40))) for k in range(15)]
    bench = spark.createDataFrame([(i, t, "x", "x") for i, t in items], "item_id long, text string, score string, doc_id string")
    want = slow_ranking([(r[0], r[1]) for r in rows], items)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert ranked(df, bench) == want
    assert ranked(df, bench, block_terms=40, tree_entries=500) == want  # many blocks, many trees
    assert ranked(empty(spark), bench) == [] and ranked(df, bench.limit(0)) == []


def test_ball_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(20, 6, replace=False)) + 20 * int(rng.integers(0, 10)) for _ in range(1500)]  # ten topics
    ptr = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    term, x = np.concatenate(rows), rng.integers(1, 10 ** 6, int(ptr[-1])).astype(float)
    tree = ball_tree.BallTree(ptr, term, x)
    dense = np.zeros((1500, 200))
    dense[np.repeat(np.arange(1500), np.diff(ptr)), term] = x
    for no, (first, end, *_) in enumerate(tree.nodes):
        q = np.where(rng.random(200) < 0.1, rng.random(200), 0.0)
        assert (dense[tree.rows[first:end]] @ q).max() <= tree.bound(no, q, float(np.sqrt(q @ q)))
    q = np.zeros(200)
    q[40:60] = 1.0
    best = np.sort(dense @ q)[-20]
    met = sum(len(r) for r in tree.leaves(q, lambda: best))
    assert 20 <= met < 750  # more than half is never scored


# ---------------------------------------------------------------- row identity

def derived(spark, tmp_path):
    """Frames over a scan in which several rows come from one row of a file."""
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, ["one two three four " * 30, "five six seven " * 40]), (2, ["one two three four " * 30, "eight nine " * 50])],
                          "doc_id long, texts array<string>").coalesce(1).write.parquet(path)
    base = spark.read.parquet(path)
    other = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "doc_id long, text string")
    return [base.select("doc_id", F.explode("texts").alias("text")), base.drop("texts").join(other, "doc_id"),
            base.select("doc_id", F.col("texts")[0].alias("text")).union(base.select("doc_id", F.col("texts")[0].alias("text"))),
            spark.read.parquet(path, path).select("doc_id", F.col("texts")[1].alias("text"))]


def test_row_ids_differ_on_derived_frames(spark, tmp_path, tokenizer):
    for df in derived(spark, tmp_path):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        assert with_row_id(df, "r").select("r").distinct().count() == len(rows)
        counted = token_count.count_tokens(df, VOCAB, chunk=40, overlap=16).collect()
        assert sorted((r["doc_id"], r["n_tokens"]) for r in counted) == sorted((i, len(ids_of(tokenizer, t)) - 1) for i, t in rows)
        check_packing(packing.pack(df, VOCAB).collect(), rows, tokenizer)
        assert simhash.drop_near_duplicates(df.withColumn("text", F.concat("text", "text"))).count() == len({t for _, t in rows})
        shards = sharding.histogram_shards(df, "doc_id", "text", shards=2).collect()
        assert len(shards) == len(rows) and len({(r["shard"], r["slot"]) for r in shards}) == len(rows)
        where = warc.archive_path(spark)
        warc.write_archive(df.select(F.monotonically_increasing_id().alias("page_id"), F.col("text").alias("html"), F.lit("u").alias("url")), where)
        kinds = Counter(r["record_type"] for r in warc.read_archive(spark, where).collect())
        assert kinds["response"] == len({t for _, t in rows}) and sum(kinds.values()) == len(rows)


def test_a_plain_scan_is_not_stored(spark):
    plan = with_row_id(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id > 3").select("doc_id"), "r")
    assert "FileScan parquet" in plan._jdf.queryExecution().executedPlan().toString()
