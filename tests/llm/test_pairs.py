"""SimHash, components, decontamination, nearest neighbours."""

import hashlib
import os
import random
import re
import sys

import numpy as np
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fixtures import SCHEMA, SF, awkward, awkward_rows, empty  # noqa: E402
from ticketflow.llm import decontam, hnsw, simhash  # noqa: E402
from ticketflow.llm.components import connected_components  # noqa: E402


def components(nodes, linked):
    """node -> least node reachable, by union-find over all pairs."""
    nodes = sorted(nodes)
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


def slow_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(64)] + [(2000, 2000 + k) for k in range(50)]
    pairs = {frozenset(e) for e in edges}
    want = {n: r for n, r in components({x for e in edges for x in e}, lambda a, b: frozenset((a, b)) in pairs).items() if n != r}
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_masks_cover_every_pair_within_the_radius():
    for bits, radius in ((list(range(64)), 2), (list(range(3, 31)), 2), (list(range(64)), 1), (list(range(20)), 3)):
        masks = simhash.covering_masks(bits, radius)
        rng = random.Random(0)
        for _ in range(3000):
            diff = sum(1 << b for b in rng.sample(bits, radius))
            assert any(not diff & m for m in masks)
    second = {64 - bin(m | o).count("1") for m in simhash.covering_masks(list(range(64)), 2)
              for o in simhash.covering_masks([b for b in range(64) if not m >> b & 1], 2)}
    assert max(second) <= simhash.FREE_BITS


def test_links_against_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    fps = {0, (1 << 64) - 1, 3, 1 << 63}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
    ball = rng.getrandbits(64)
    fps |= {ball ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)}
    want = components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    for limit in (4096, 5):  # 5: buckets above it are covered again
        monkeypatch.setattr(simhash, "MAX_BUCKET", limit)
        edges = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in simhash.links(spark.createDataFrame(signed, "fp long"), 2).collect()]
        assert all((a ^ b).bit_count() <= 2 or want[a] == want[b] for a, b in edges)
        pairs = {frozenset(e) for e in edges}
        assert components(fps, lambda a, b: frozenset((a, b)) in pairs) == want


def test_simhash_rows(spark):
    rows = awkward_rows()
    rng = random.Random(9)
    base = "a long text of many words " + " ".join(str(rng.random()) for _ in range(3000))
    rows += [(500 + k, base.replace(" of ", f" of {'very ' * k}", 1), "en", "a", 1, *["x"] * 9) for k in range(6)]
    got = simhash.simhash_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    fps = {r[1]: slow_fingerprint(r[1]) for r in rows}
    comp = components(set(fps.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    least: dict = {}
    for r in rows:
        c = comp[fps[r[1]]]
        least[c] = min((x for x in (least.get(c), r[0]) if x is not None), default=None)
    want = sorted((repr(r[0]), f"{fps[r[1]]:016x}", repr(least[comp[fps[r[1]]]])) for r in rows)
    assert sorted((repr(r["doc_id"]), r["fingerprint"], repr(r["component_id"])) for r in got) == want
    assert sum(r["keeper"] for r in got) == len(least)
    assert simhash.simhash_groups(empty(spark)).count() == 0


def test_drop_near_duplicates_keeps_one_of_each_group(spark, tmp_path):
    df = awkward(spark)
    df.write.parquet(str(tmp_path / "d"))
    for docs in (df, spark.read.parquet(str(tmp_path / "d"))):  # generated and file row ids
        for limit in (1_000_000, 0):  # broadcast and shuffled anti-join
            out = simhash.drop_near_duplicates(docs, broadcast_rows=limit)
            assert out.columns == docs.columns
            fps = [slow_fingerprint(r["text"]) for r in out.collect()]
            assert len(set(fps)) == len(fps)
    assert simhash.drop_near_duplicates(empty(spark)).count() == 0


def slow_words(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def slow_contamination(text, items, window=10):
    ws, hit, found = slow_words(text), set(), set()
    for key, item in items:
        iw = slow_words(item)
        n = min(window, len(iw))
        wins = {tuple(iw[k:k + n]) for k in range(len(iw) - n + 1)} if n else set()
        for k in range(len(ws) - n + 1) if n else ():
            if tuple(ws[k:k + n]) in wins:
                hit |= set(range(k, k + n))
                if key is not None:
                    found.add(str(key))
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(2)
    vocab = ["aa", "bb", "cc", "Dé", "中"]  # few words: many overlaps and suffix links
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 14, 30])))) for k in range(40)]
    items += [(3, items[7][1]), (None, "zz yy xx"), (77, None), (78, "Q, r-s!")]
    docs = [(k, "; ".join(rng.choice(vocab + ["nn"]) for _ in range(rng.randint(0, 60)))) for k in range(60)]
    docs += [(100, items[8][1]), (101, "x zz, YY xx. q r s"), (None, None), (102, ""), (103, "Q R S"), (103, "Q R S")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    want = sorted((repr(d), *slow_contamination(t, items)) for d, t in docs)
    for block in (100_000, 25):  # 25 words: many blocks, and items cut into pieces
        got = decontam.decontaminate(df, bench, block_words=block).drop("spans").collect()
        assert sorted((repr(r[0]), *r[1:]) for r in got) == want
    assert decontam.decontaminate(empty(spark), bench).count() == 0
    assert not any(r["contaminated"] for r in decontam.decontaminate(df, bench.limit(0)).collect())


def test_remove_benchmark(spark):
    item = " ".join(f"w{k}" for k in range(12))
    split = " ".join(f"w{k}" for k in range(6)), " ".join(f"w{k}" for k in range(6, 12))
    filler = " ".join(f"f{k}" for k in range(60))
    texts = [filler, f"{filler} {item}. {filler}", f"{filler} {split[0]} {item} {split[1]} {filler}", item, "", None]
    rows = [(k, t, "en", "a", len(t or ""), *["x"] * 9) for k, t in enumerate(texts)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.remove_benchmark(spark.createDataFrame(rows, SCHEMA), bench).collect()}
    # over several blocks: other items before and after, and cut pieces of one long item
    more = bench.union(spark.createDataFrame([(2, " ".join(f"z{k}" for k in range(90))), (3, "y1 y2 y3")], bench.schema))
    parts = {r["doc_id"]: r for r in decontam.remove_benchmark(spark.createDataFrame(rows, SCHEMA), more, block_words=20).collect()}
    assert parts == got
    assert sorted(got) == [0, 1, 2, 4, 5]  # the document that is the item goes
    assert got[0]["text"] == filler and got[5]["text"] is None and got[0]["_clean"] == "x"
    for k in (1, 2):
        assert slow_contamination(got[k]["text"], [(1, item)])[1] == 0  # also where a cut joined two halves
        assert got[k]["text"].count("f59") == 2 and got[k]["n_chars"] == len(got[k]["text"])


def test_nearest_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 16)).astype(np.float32)
    x[300:600] = x[0]  # a large group of copies
    rows = [(k, x[k].tolist()) for k in range(1200)] + [(7, x[7].tolist())]
    bad = [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (None, x[3].tolist()), (5150, [float("inf")] + [1.0] * 15), (5200, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("id", F.lit(2))
    got: dict = {}
    for r in hnsw.search(df, shard_rows=300).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    d = x.astype(np.float64)
    hits = 0
    assert set(got) == set(range(0, 1200, 50))
    for q, found in got.items():
        s = np.array([hnsw.exact_cosine(d[q], d[k:k + 1])[0] for k in range(1200)])
        s[q] = -9
        want = np.lexsort((np.arange(1200), -s))[:5].tolist()
        assert sorted(found) == [1, 2, 3, 4, 5] and q not in [i for i, _ in found.values()]
        assert all(abs(sc - s[i]) < 1e-12 for i, sc in found.values())
        order = [(-sc, i) for _, (i, sc) in sorted(found.items())]
        assert order == sorted(order)
        hits += len(set(want) & {i for i, _ in found.values()})
        if q == 0 or 300 <= q < 600:  # copies: ties to the smallest ids, exactly
            assert [found[r][0] for r in range(1, 6)] == want
    assert hits >= 0.9 * 5 * len(got)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert hnsw.search(few).count() == 2
    assert hnsw.search(few.limit(0)).count() == 0


def test_repeated_rows_take_no_place_of_other_ids(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(100, 8))
    x[50:56] = x[50]  # k + 1 ids of one vector
    rows = [(k, x[k].tolist()) for k in range(100)]
    rows += [row for row in rows[50:56]] * 2 + [rows[50]] * 20
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in hnsw.search(df).collect()}
    assert [got[50, rank] for rank in range(1, 6)] == [51, 52, 53, 54, 55]


def test_recall_on_the_embeddings_table(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    t = e.select("vec_id", "embedding").toPandas()
    x = np.stack(t["embedding"]).astype(np.float64)
    u, ids = x / np.linalg.norm(x, axis=1, keepdims=True), t["vec_id"].to_numpy()
    hits = total = 0
    got = hnsw.search(e).toPandas().groupby("query_id")["vec_id"].agg(set)
    for q, found in got.items():
        i = int(np.nonzero(ids == q)[0][0])
        s = u @ u[i]
        s[i] = -9
        hits += len(found & set(ids[np.lexsort((ids, -s))[:5]].tolist()))
        total += 5
    assert total == 5 * int((ids % 50 == 0).sum()) and hits >= 0.9 * total


def test_graph_survives_its_flat_form():
    x = np.random.default_rng(0).normal(size=(200, 8))
    g = hnsw.build(x)
    h = hnsw.Graph.of_flat(g.unit, g.levels.astype(np.int32), g.flat(), g.entry)
    for q in g.unit[:20]:
        assert sorted(g.nearest(q, 20)) == sorted(h.nearest(q, 20))


