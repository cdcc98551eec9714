"""The pipeline's stages on nulls, repeats, ties, empty and long texts, empty tables and columns with odd names."""

import hashlib
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sonoshelf.llm import quality
from sonoshelf.llm.common import shared_dir

EXTRA = "label string, kept string, keep_id string, copy_key string, _gone string, _node string, n string, h string, size string, path string, ids string, Block string"


@pytest.fixture(scope="module")
def docs(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base, "a"), (2, base, "a"), (3, base + " more", None), (4, None, "b"), (5, "", "b"), (6, "x " * 20_000, "c"), (7, "one two", None), (7, "one two", None), (None, "null id", "a"), (8, "  ", "c")]
    names = [c.split()[0] for c in EXTRA.split(", ")]
    return spark.createDataFrame([(*r, *[f"{c}{k}" for c in names]) for k, r in enumerate(rows)], f"doc_id long, text string, source string, {EXTRA}")


@pytest.fixture
def lenient(monkeypatch):
    monkeypatch.setattr(quality, "THRESHOLD", 0.0)  # so that all rows come to the later stages


def test_stages_keep_columns_and_values(spark, docs, tmp_path, lenient):
    spark.createDataFrame([(1, 1), (6, 0), (7, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    seen, rows = docs, {tuple(r) for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = spark.createDataFrame(stage(spark, seen, str(tmp_path)).collect(), docs.schema)
        assert seen.schema == docs.schema
        assert {tuple(r) for r in seen.collect()} <= rows
    texts = [r.text for r in seen.collect()]
    assert "x " * 20_000 in texts and len([t for t in texts if t and t.startswith("w0")]) <= 3
    last = corpus_pipeline.STAGES[-1][1](spark, seen, str(tmp_path))
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(r.decoded_sha256 for r in last.collect()) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for t in texts)


def test_each_stage_on_its_own(spark, docs, tmp_path):
    dedup, near = corpus_pipeline.drop_copies(spark, docs, ""), corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(((r.doc_id, r.text) for r in dedup.collect()), key=repr) == sorted([(2, docs.first().text), (3, docs.first().text + " more"), (5, ""), (6, "x " * 20_000), (7, "one two"), (None, "null id"), (8, "  ")], key=repr)
    assert sorted(((r.doc_id, (r.text or "")[:7]) for r in near.collect()), key=repr) == sorted([(1, "w0 w1 w"), (4, ""), (6, "x x x x"), (7, "one two"), (7, "one two"), (None, "null id")], key=repr)


def test_an_empty_corpus(spark, docs, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_without_labels_every_document_is_rejected(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.keep_quality(spark, docs.withColumn("quality", F.lit(1)), str(tmp_path)).collect() == []


def test_only_what_the_result_reads_stays_behind(spark, docs, tmp_path, lenient):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    folder = Path(urlparse(shared_dir(spark)).path)
    before = set(folder.iterdir())
    corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.name.split("-")[0] for x in set(folder.iterdir()) - before} <= {"stage3"}
