"""The pipeline: each stage over all its predecessor kept."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline  # noqa: E402
from fixtures import SF, awkward, empty  # noqa: E402
from test_pairs import slow_contamination, slow_fingerprint  # noqa: E402


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "mix", "shard"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = {r["doc_id"]: r for r in docs.collect()}
        assert set(rows) <= set(before) and rows
        if name != "shard":
            assert docs.columns == columns
        if name == "near_dedup":
            fps = [slow_fingerprint(r["text"]) for r in rows.values()]
            assert all((a ^ b).bit_count() > 2 for k, a in enumerate(fps) for b in fps[:k])
        elif name == "decontaminate":
            hit = {k: slow_contamination(r["text"], items)[4] for k, r in before.items()}
            assert not any(slow_contamination(r["text"], items)[4] for r in rows.values())
            assert all(rows[k] == r for k, r in before.items() if not hit[k])
        elif name != "shard":
            assert all(before[k] == r for k, r in rows.items())
        else:
            assert len(rows) == len(before) and docs.columns == [*columns, "size", "shard", "slot"]
        before = rows
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in corpus_pipeline.run(spark, SF).collect()} and len(rows) > 0


def test_stages_bear_awkward_and_empty_tables(spark):
    for docs in (awkward(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= docs.count()
            if name != "shard":
                assert out.columns == docs.columns
