"""Quality, toxicity, PII, token counts, WARC, mixing, sharding."""

import base64
import hashlib
import os
import random
import re
import sys

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fixtures import SCHEMA, awkward, awkward_rows, empty, prose  # noqa: E402
from ticketflow.llm import mixing, pii, quality, sharding, token_count, toxicity, warc  # noqa: E402

SF1 = "/root/testdata/sf0.1"  # enough labels for each part of the sample
VOCAB = public_tokenizers.path("byte_bpe_50k.json")


def _auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("module,label,least", [(quality, "quality", 0.98), (toxicity, "toxic", 0.97)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = spark.read.parquet(f"{SF1}/documents.parquet"), spark.read.parquet(f"{SF1}/labels.parquet")
    out = module.score(docs, module.fit(docs, labels))
    rows = [(r["score"], r[label]) for r in out.join(labels, "doc_id").where("held_out").collect()]
    assert _auc(rows) >= least
    assert out.count() == docs.count()
    assert out.where("score < 0 or score > 1 or score is null or isnan(score)").count() == 0


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifier_edges(spark, module, label):
    rows = awkward_rows()
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)] + [(3, 0), (3, 1), (None, 1), (4, None), (5, 7)], f"doc_id long, {label} int").withColumn("text", F.lit("x"))
    df = awkward(spark)
    for given in (labels, labels.limit(0), labels.where(f"{label} = 1")):  # both labels, none, one
        out = module.score(df, module.fit(df, given)).collect()
        assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in out)
    assert module.score(empty(spark), module.fit(empty(spark), labels)).count() == 0


def test_statistics_are_finite():
    for data in (b"", b" ", b"\n\n", b"x", "é中😀".encode(), b"\xff\xfe", b"A! B? C.\nA! B? C.\n" * 50):
        assert np.isfinite(quality.statistics(data)).all() and len(quality.statistics(data)) == len(quality.STATISTICS)


def test_rules_hold_where_their_path_does(spark):
    rule = quality.Rule(((0, 1.0, 2.0), (3, float("-inf"), 5.0)))
    df = spark.createDataFrame([([1.0, 0.0, 0.0, 5.0],), ([2.0, 0.0, 0.0, 5.0],), ([1.5, 0.0, 0.0, 5.1],)], "s array<double>")
    assert [r[0] for r in df.select(rule.column(F.col("s"))).collect()] == [False, True, False]


def test_keep_good_keeps_columns(spark):
    df = awkward(spark)
    assert quality.keep_good(df, quality.RuleModel([], [], 5.0)).columns == df.columns
    assert quality.keep_good(df, quality.RuleModel([], [], 5.0)).count() == df.count()


def test_toxic_features():
    lexicon = {"scum": 5.0, "schl~": 4.0}
    plain = dict(zip(toxicity.FEATURES, toxicity.features("you SCUM! and schlecht words", lexicon)))
    hidden = dict(zip(toxicity.FEATURES, toxicity.features("some s¢ words $cum here", lexicon)))
    assert plain["word_hits"] == pytest.approx(np.log1p(1)) and plain["prefix_hits"] == pytest.approx(np.log1p(1))
    assert plain["hits_near_second_person"] == 1 and plain["shouted_words"] > 0 and plain["disguised_hits"] == 0
    assert hidden["disguised_hits"] == 1
    assert len(toxicity.features("", {})) == len(toxicity.FEATURES)


def _luhn(d):
    return sum((lambda x: x - 9 if x > 9 else x)(int(c) * (1 + k % 2)) for k, c in enumerate(reversed(d))) % 10 == 0


def slow_pii(t):
    t, out = t or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and _luhn(digits(s))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15)]
    for kind, pattern, ok in rules:
        out += [(kind, *m.span()) for m in re.finditer(pattern, t) if ok(m[0])]
    return out


def test_pii_against_brute_force(spark):
    rng = random.Random(6)
    bits = ["a@b.co", "a@b.c@d.e", "x.y%z@q-r.s.t%u@v.w", "@", "é", "中", " ", "\n", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "0000255.01.2.3", "4111 1111 1111 1111",
            "4111-1111-1111-1112", "4111111111111111", "+1 (555) 555-0199", "+1..", "+49 30 1234567", "12", "-", ".", "+", "7", "😀", "ab", "@@x.y"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += [r[1] for r in awkward_rows()] + ["1 " * 30_000, "a" * 200_000, "a@b.co " * 2000, "1." * 5000, "+1" * 5000, "9" * 20_000, "a@" * 20_000]
    df = spark.createDataFrame([(k, t, "x", "x", "x") for k, t in enumerate(texts)], "doc_id long, text string, email string, _t string, spans string")
    got = {r["doc_id"]: r for r in pii.digest(pii.find_pii(df)).collect()}
    for k, t in enumerate(texts):
        want = slow_pii(t)
        spans = ",".join(f"{a}:{b}:{c}" for a, b, c in want)
        assert got[k]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest(), (t[:300], got[k]["spans"][:300])
        assert [got[k][f"n_{x}"] for x in pii.BASE] == [sum(s[0] == x for s in want) for x in pii.BASE]
    assert pii.find_pii(empty(spark)).count() == 0


def test_iban_and_context(spark):
    rows = [(1, "my account DE89370400440532013000 ok"), (2, "DE89370400440532013001"), (3, "call me: +1 555 555 0199"), (4, "zz +1 555 555 0199")]
    got = {r["doc_id"]: r for r in pii.digest(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[1]["spans"] == "iban:11:33" and got[1]["max_score"] == 0.9 and got[2]["spans"] == ""
    assert got[3]["max_score"] == 0.7 and got[4]["max_score"] == 0.6


def test_token_counts_against_whole_texts(spark):
    rng = random.Random(8)
    bits = ["word ", "  ", "\n\n\n", "don't ", "<|endoftext|>", "<|endo", "ftext|>", "中文字", "😀", "é", "1234567", "x" * 50, " " * 70, "\t", ", ", "'s", "a"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 400))) for _ in range(120)]
    texts += [r[1] for r in awkward_rows()] + [" " * 3000, "中" * 2000, "ab " * 3000, "<|endoftext|>" * 200]
    t = Tokenizer.from_file(VOCAB)
    want = sorted((repr(k), len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for k, x in enumerate(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    for chunk, overlap in ((16_384, 256), (100, 40), (64, 20)):  # the last: many seams fail and widen
        got = token_count.count_tokens(df, VOCAB, chunk=chunk, overlap=overlap).collect()
        assert sorted((repr(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert token_count.count_tokens(empty(spark), VOCAB).count() == 0
    n = token_count.count_tokens(awkward(spark), VOCAB).count()
    assert n == len(awkward_rows())
    with pytest.raises(ValueError):
        token_count.count_tokens(df, public_tokenizers.path("word_bpe_49k.json"))


def test_chunk_spans_cover_the_text():
    for n in (0, 1, 99, 100, 139, 140, 141, 1000):
        spans = token_count.chunk_spans(n, 100, 40)
        assert spans[0][0] == 0 and spans[-1][1] == n
        assert all(b[0] == a[0] + 100 and a[1] == a[0] + 140 for a, b in zip(spans, spans[1:]))


def _base32(x):
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


def test_warc_round_trip(spark):
    rng = random.Random(7)
    pages = [(k, f"http://h/{k}\r\nX: y", "".join(rng.choice(["a", "é", "\r\n\r\n", "WARC/1.1\r\n", "0\r\n", "中"]) for _ in range(rng.randint(0, 400)))) for k in range(40)]
    pages += [(50, None, None), (51, "", ""), (None, "u", "null page"), (52, "u", "null page"), (53, "u", "twice"), (53, "u", "twice")]
    pages += [(100 + k, "u", "shared payload") for k in range(30)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("x")).repartition(4)
    for segment, limit in ((16_384, 200_000), (128, 0)):
        path = warc.archive_path(spark)
        warc.write_archive(df, path, segment=segment, broadcast_rows=limit)
        got = warc.read_archive(spark, path).collect()
        assert all(r["complete"] for r in got)
        win: dict = {}
        for p, _, h in pages:
            win[h or ""] = max(win.get(h or "", -1), -1 if p is None else p)
        body = {r["page_id"]: bytes(r["payload"]).decode() for r in got if r["record_type"] == "response"}
        assert all(body[None if p is None else str(p)] == (h or "") for p, _, h in pages if win[h or ""] == p)
        want, seen = [], set()
        for p, _, h in sorted(pages, key=lambda x: -1 if x[0] is None else x[0]):
            data, first = (h or "").encode(), win[h or ""] == p and p not in seen
            seen |= {p} if first else set()
            want.append((repr(None if p is None else str(p)), len(data), _base32(data), "response" if first else "revisit",
                         repr(None if first else str(win[h or ""]))))
        assert sorted((repr(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], repr(r["refers_to"])) for r in got) == sorted(want)
    path = warc.archive_path(spark)
    warc.write_archive(df.limit(0), path)
    assert warc.read_archive(spark, path).count() == 0


def test_warc_reassembly_order_gaps_and_lengths(spark):
    block = warc._http(b"hello world " * 50)
    parts = [block[k:k + 100] for k in range(0, len(block), 100)]
    rows = []
    for origin, numbers, total in (("a", range(1, len(parts) + 1), len(block)), ("b", [1, 3, 4], len(block)), ("c", range(1, len(parts) + 1), 5),
                                   ("d", [*range(1, len(parts) + 1), 2], len(block))):
        for no in numbers:
            first = no == 1
            rows.append(("response" if first else "continuation", origin if first else f"{origin}:{no}", "x" if first else None, None, no,
                         None if first else origin, total if no == len(parts) else -1, bytearray(parts[no - 1])))
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "type string, record_id string, digest string, refers_to string, segment int, origin string, total long, block binary")
    got = {r["record_id"]: r["block"] for r in warc.reassemble(df).collect()}
    assert bytes(got["a"]) == block == bytes(got["d"]) and got["b"] is None and got["c"] is None
    assert warc.decode_http(block) == b"hello world " * 50
    with pytest.raises(ValueError):
        warc.dechunked(b"3\r\nabcd\r\n0\r\n\r\n")


def test_raking_meets_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-7)
    rng = random.Random(1)
    cells = [(s, lang, t, rng.randint(1, 500)) for s in ["a", "b", "c", None] for lang in ["en", "fr"] for t in range(3)]
    df = spark.createDataFrame(cells, "source string, lang string, topic int, mass long")
    margins = {c: mixing.tempered(df, c, 0.5) for c in ("source", "lang", "topic")}
    total = sum(c[3] for c in cells)
    results = []
    for limit in (200_000, 0):  # in numpy, and by joins
        got = mixing.rake_cells(df, margins, 0.6, limit).collect()
        for c in margins:
            for r in margins[c].collect():
                mass = sum(x["mass"] * x["ratio"] for x in got if x[c] == r[c])
                assert mass / total == pytest.approx(r["share"], abs=1e-6)
        assert sum(x["mass"] * x["probability"] for x in got) == pytest.approx(0.6 * total, rel=1e-6)
        assert all(0 <= x["probability"] <= 1 for x in got)
        results.append({(x["source"], x["lang"], x["topic"]): x["probability"] for x in got})
    assert results[0].keys() == results[1].keys()
    assert all(results[0][k] == pytest.approx(results[1][k], abs=1e-6) for k in results[0])


def _misses(rows, margins, key="mass"):
    """The most by which the expected kept shares miss their targets."""
    kept = sum(r[key] * r["probability"] for r in rows)
    return max(abs(sum(r[key] * r["probability"] for r in rows if r[c] == k) / kept - share)
               for c, shares in margins.items() for k, share in shares.items())


def test_kept_shares_meet_their_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-7)
    rng = random.Random(2)
    cells = [(s, lang, t, rng.randint(200, 300) * (40 if s == "hot" else 1) * (6 if lang == "en" else 1))
             for s in ["hot", "b", "c", None] for lang in ["en", "fr"] for t in range(2)]
    df = spark.createDataFrame(cells, "source string, lang string, topic int, mass long")
    margins = {c: mixing.tempered(df, c, p) for c, p in zip(("source", "lang", "topic"), (0.9, 0.9, 0.5))}
    want = {c: {r[c]: r["share"] for r in m.collect()} for c, m in margins.items()}
    total = sum(c[3] for c in cells)
    free = max(r["ratio"] for r in mixing.rake_cells(df, margins, 0.01).collect())
    assert 0.7 * free > 1  # cells at probability 1
    for limit in (200_000, 0):  # in numpy, and by joins
        got = mixing.rake_cells(df, margins, 0.7, limit).collect()
        assert _misses(got, want) < 1e-5 and all(0 <= r["probability"] <= 1 for r in got)
        assert sum(r["mass"] * r["probability"] for r in got) == pytest.approx(0.7 * total, rel=1e-5)
    # shares that no sample of this size has: less is kept, but not less than without a cell at 1
    margins = {c: mixing.tempered(df, c, 0.5) for c in margins}
    want = {c: {r[c]: r["share"] for r in m.collect()} for c, m in margins.items()}
    monkeypatch.setattr(mixing, "HALVINGS", 2)
    for limit in (200_000, 0):
        got = mixing.rake_cells(df, margins, 0.7, limit, targets_first=True).collect()
        assert _misses(got, want) < 1e-5 and all(0 <= r["probability"] <= 1 for r in got)
        assert 1 / max(r["ratio"] for r in mixing.rake_cells(df, margins, 0.01).collect()) - 1e-6 <= \
            sum(r["mass"] * r["probability"] for r in got) / total < 0.7


def test_documents_of_a_hot_source_meet_their_targets(spark):
    rows = [(k, prose(random.Random(k), 5 + k % 40), "en" if k % 5 else "fr", "hot" if k % 3 == 0 else f"s{k % 7}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = mixing.mix(df, keep=0.8, targets_first=True).collect()
    assert all(r["target_miss"] <= mixing.MISS for r in got)
    assert 0.97 * 0.8 - 1e-9 <= sum(r["n_tokens"] * r["probability"] for r in got) / sum(r["n_tokens"] for r in got) <= 0.8 + 1e-9
    misses = []
    for pull in mixing.PULLS:
        misses.append(_misses(got, _hot_targets(got, pull), "n_tokens"))
    assert min(misses) < 1e-5
    assert mixing.sample(df, keep=0.8, targets_first=True).count() == sum(r["kept"] for r in got)


def _hot_targets(got, pull):
    want = {}
    for c, asked in zip(("source", "lang", "topic"), (0.5, 0.7, 0.5)):
        power = 1 - (1 - asked) * pull
        mass: dict = {}
        for r in got:
            mass[r[c]] = mass.get(r[c], 0) + r["n_tokens"]
        share = {k: m ** power / sum(x ** power for x in mass.values()) for k, m in mass.items()}
        most = {k: m / sum(mass.values()) / 0.8 for k, m in mass.items()}  # what a category has where 0.8 is kept
        full: set = set()
        while True:
            scale = (1 - sum(most[k] for k in full)) / sum(share[k] for k in share if k not in full)
            new = {k for k in share if k not in full and share[k] * scale >= most[k]}
            if not new:
                break
            full |= new
        want[c] = {k: most[k] if k in full else share[k] * scale for k in share}
    return want


def test_mix_rows(spark):
    df = awkward(spark)
    out = mixing.mix(df)
    got = out.collect()
    assert len(got) == len(awkward_rows()) and out.columns == ["doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "kept", "target_miss"]
    words = sorted((repr(r[0]), len((r[1] or "").encode().split()) + 1) for r in awkward_rows())
    assert sorted((repr(r["doc_id"]), r["n_tokens"]) for r in got) == words
    assert sum(r["n_tokens"] * r["probability"] for r in got) == pytest.approx(0.6 * sum(r["n_tokens"] for r in got), rel=1e-6)
    kept = mixing.sample(df)
    assert kept.columns == df.columns and kept.count() == sum(r["kept"] for r in got)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.sample(empty(spark)).count() == 0


def _check_shards(rows, total_rows, shards=16, slack=0.0):
    assert len(rows) == total_rows
    by: dict = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    sizes = [sum(r["size"] for r in by.get(k, [])) for k in range(shards)]
    assert max(abs(s - sum(sizes) / shards) for s in sizes) <= 2 * max(r["size"] for r in rows) + slack


def test_shards_are_even(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, "é" * rng.randint(0, 40)) for k in range(900)] + [(5, "the same row")] * 450 + [(None, None)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("x")).withColumn("_key", F.lit("x"))
    df.write.parquet(str(tmp_path / "d"))
    for docs in (df, spark.read.parquet(str(tmp_path / "d"))):
        for part in (32 << 20, 200):  # 200 bytes: many ranges a shard
            out = sharding.histogram_shards(docs, "doc_id", "text", part_bytes=part)
            assert out.columns == ["doc_id", "text", "_key", "size", "shard", "slot"]
            got = out.collect()
            _check_shards(got, len(rows))
            assert sorted((repr(r["doc_id"]), repr(r["text"]), r["size"]) for r in got) == sorted(
                (repr(k), repr(t), len((t or "").encode()) + 1) for k, t in rows)
    assert sharding.histogram_shards(empty(spark), "doc_id", "text").count() == 0
    one = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert [r["slot"] for r in sharding.histogram_shards(one, "doc_id", "text").collect()] == [0]


def test_splitters_against_sorted_rows(spark):
    rng = random.Random(4)
    rows = [(rng.randint(-(1 << 63), (1 << 63) - 1), rng.randint(1, 100)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "key long, size long")
    found, total = sharding.find_splitters(df, 8, 0.0)
    assert total == sum(s for _, s in rows) and found == sorted(found)
    for j, key in enumerate(found, 1):
        below = sum(s for k, s in rows if k < key)
        assert abs(below - total * j / 8) <= 50  # half a row: no key is nearer
