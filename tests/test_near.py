"""K5: MinHash bands against brute force, big buckets, edge rows."""

import random

import numpy as np

from ticketflow.operators import near
from ticketflow.operators.components import connected_components


def _shingles(text, n=5):
    w = [x for x in (text or "").lower().split() if x]
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def _slow(rows, threshold=0.8):
    """(pairs, {id: (class, group)}) by comparing all texts."""
    words = {i: tuple((t or "").lower().split()) for i, t in rows if i is not None}
    cls = {i: min(j for j in words if words[j] == words[i]) for i in words}
    reps = sorted({c for c in cls.values() if words[c]})
    sets = {c: _shingles(" ".join(words[c])) for c in reps}
    pairs = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in reps for b in reps if a < b}
    pairs = {k: v for k, v in pairs.items() if v >= threshold}
    root = {c: c for c in cls.values()}
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            m = min(root[a], root[b])
            moved |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    return pairs, {i: (c, root[c]) for i, c in cls.items()}


def _check(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", "x") for i, t in rows], "doc_id long, text string, class_id string, shingles string").repartition(3)
    pairs, groups = near.similar_texts(df, **kw)
    want_pairs, want_groups = _slow(rows)
    got = {(r.a, r.b): r.similarity for r in pairs.collect()}
    assert got.keys() == want_pairs.keys()
    assert all(abs(got[k] - want_pairs[k]) < 1e-12 for k in got)
    assert {r.doc_id: (r.class_id, r.group_id) for r in groups.collect()} == want_groups
    return got


def _prose(rng, n):
    return " ".join("".join(rng.choice(["ba", "ke", "lo", "mi", "nu", "ra"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def _changed(rng, text, words):
    w = text.split()
    for _ in range(words):
        w[rng.randrange(len(w))] = _prose(rng, 1)
    return " ".join(w)


def test_pairs_and_groups_against_brute_force(spark):
    rng = random.Random(3)
    base = [_prose(rng, rng.randint(4, 150)) for _ in range(60)]
    rows = list(enumerate(base + [_changed(rng, rng.choice(base), rng.randint(0, 4)) for _ in range(150)]))
    rows += [(900, ""), (901, None), (902, " \n "), (903, "one two"), (904, "One  TWO"), (905, "one two three four five"), (None, base[0]), (906, "x" * 5000)]
    rows += [rows[3]] * 3  # repeated rows
    assert len(_check(spark, rows)) > 20
    assert _check(spark, []) == {}


def test_a_third_of_the_rows_alike(spark, monkeypatch):
    """Near copies fill buckets beyond the limit: they are split and compared in blocks."""
    rng = random.Random(4)
    monkeypatch.setattr(near, "BIG", 30)
    hot = _prose(rng, 120)
    rows = list(enumerate([_changed(rng, hot, rng.randint(0, 2)) for _ in range(120)] + [_prose(rng, 60) for _ in range(240)]))
    got = _check(spark, rows)
    assert len(got) > 1_000  # all links between the near copies, which is their number squared


def test_a_common_passage_is_no_link(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(near, "BIG", 20)
    passage = _prose(rng, 60)
    _check(spark, [(k, f"{passage} {_prose(rng, 60)}") for k in range(150)])


def test_band_keys_miss_as_stated():
    rng = np.random.default_rng(1)
    shared = missed = 0
    for _ in range(400):
        x = rng.integers(-1 << 62, 1 << 62, 180)
        a, b = x[:100], np.concatenate([x[:80], x[100:120]])  # 80 shared of 120: Jaccard 2/3
        same = (near.band_keys(a, 200, 4, 1) == near.band_keys(b, 200, 4, 1)).mean()
        shared += same
        missed += not (near.band_keys(a, near.BANDS, near.ROWS, 2) == near.band_keys(b, near.BANDS, near.ROWS, 2)).any()
    assert abs(shared / 400 - (2 / 3) ** 4) < 0.02
    assert missed / 400 < 0.02 and near.miss_probability(0.8) < 1e-7


def test_components_against_union_find(spark):
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200, k) for k in range(201, 300)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "u long, v long")
    assert {r.node: r.root for r in connected_components(df).collect()} == {n: r for n, r in root.items() if n != r}
    assert connected_components(df.limit(0)).count() == 0
