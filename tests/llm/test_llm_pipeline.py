"""The pipeline, stage by stage, against plain Python."""

import corpus_pipeline as pipeline
from seqprep.llm.common import staged

from .conftest import HOSTILE, SCHEMA
from .test_llm_search import plain_classes, plain_search
from .test_llm_tokens import check_packing


def test_stages(spark, sf_dir, documents, texts):
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "packing"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs, kept = documents, dict(texts)
    for name, stage in pipeline.STAGES:
        docs = staged(stage(spark, docs, sf_dir))
        if name != "packing":
            assert docs.columns == documents.columns
            left = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert len(left) == docs.count()
            if name == "language":
                assert len(left) >= 0.99 * len(kept)
            elif name == "near_duplicates":
                assert set(left) == {k for k, c, _ in plain_classes(sorted(kept.items())) if k == c}
            else:
                wanted = {k for k, _, n, _ in plain_search(kept.items(), items, 10) if not n}
                assert set(left) == wanted and len(left) < len(kept)
            kept = left
    check_packing(docs.collect(), list(kept.items()), 2048)


def test_hostile_documents(spark, sf_dir, hostile, tmp_path):
    hostile.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = hostile, []
    for _, stage in pipeline.STAGES[:3]:
        docs = staged(stage(spark, docs, str(tmp_path)))
        seen.append(sorted((r["doc_id"] or 0, (r["text"] or "")[:20]) for r in docs.collect()))
    language, near, clean = seen
    # No language: null, empty and without letters. One of the four rows of one text stays.
    gone = {r[0] for r in HOSTILE} - {k or None for k, _ in language}
    assert {4, 5, 6} <= gone and 7 not in gone and None not in gone
    assert sum(t.lower().startswith("the quick brown") for _, t in language) == 4
    assert sum(t.lower().startswith("the quick brown") for _, t in near) == 1
    assert len({t for _, t in language}) - 1 <= len(near) == len({t.lower() for _, t in near})
    assert clean == near  # the benchmark has nothing of these
    check_packing(pipeline.packing(spark, docs, "").collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], 2048)


def test_empty_documents(spark, sf_dir, hostile, tmp_path):
    hostile.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_clean_documents_stay_whatever_their_id(spark, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, item), (None, "clean"), (7, f"so {item}"), (7, "clean too"), (8, item), (None, None), (None, "clean")]
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], SCHEMA)
    kept = pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, ""), (0, "clean"), (0, "clean"), (7, "clean too")]
