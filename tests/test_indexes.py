"""The stored indexes: recall and whole results against the scans they stand for, and what they read."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sonoshelf.operators import chunking, search, text_index, vector_index

DATA = "/root/testdata"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files(df):
    return [r.f for r in df.select(F.input_file_name().alias("f")).distinct().collect()]


def exact(x, ids, queries, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return {ids[q]: {ids[j] for j in np.lexsort((ids, -(x @ x[q])))[:k]} for q in queries}


def searched(spark, at, df, ids, **options):
    asked = df.where(F.col("vec_id").isin([int(i) for i in ids])).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = vector_index.Search(spark, at, asked, **options)
    out = {}
    for r in found.hits().collect():
        out.setdefault(r.query_id, {})[r.id] = (r.rank, r.similarity)
    return found, out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, tmp_path, sf):
    """They are independent in 64 dimensions (the nearest has a cosine of 0.37), so three lists of five are looked into."""
    at, df = str(tmp_path), spark.read.parquet(f"{DATA}/{sf}/embeddings.parquet")
    vector_index.build(df, at, id_col="vec_id")
    t = pq.read_table(f"{DATA}/{sf}/embeddings.parquet")
    ids, x = np.array(t["vec_id"]), np.array(t["embedding"].to_pylist(), float)
    want = exact(x, ids, range(0, len(ids), len(ids) // 100), 10)
    found, got = searched(spark, at, df, want)
    assert np.mean([len(want[q] & got[q].keys()) / 10 for q in want]) >= 0.9
    sizes = {r["list"]: r["count"] for r in vector_index.index_rows(spark, at).groupBy("list").count().collect()}
    assert sum(sizes.values()) == len(ids)
    looked = np.mean([sum(sizes.get(li, 0) for li in lists) / len(ids) for lists in found.lists.tolist()])
    code = vector_index.index_rows(spark, at).first().code
    short = found.keep / len(ids)
    # codes of the probed lists and whole vectors of the short list, in shares of all vectors' bytes
    assert looked * len(code) / (4 * x.shape[1]) + short <= 0.2
    for q in list(want)[:5]:
        i = ids.tolist().index(q)
        for j, (_, s) in got[q].items():
            y = x[ids.tolist().index(j)]
            assert s == pytest.approx(x[i] @ y / np.linalg.norm(x[i]) / np.linalg.norm(y))


def test_recall_on_vectors_in_groups(spark, tmp_path):
    """Where vectors lie in groups, a tenth of the lists is enough."""
    g = np.random.default_rng(1)
    x = g.normal(size=(40, 32))[g.integers(0, 40, 3000)] + 0.25 * g.normal(size=(3000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    at, ids = str(tmp_path), np.arange(3000)
    vector_index.build(df, at, id_col="vec_id", lists=40)
    want = exact(x, ids, range(0, 3000, 30), 10)
    found, got = searched(spark, at, df, want, probes=4)
    assert np.mean([len(want[q] & got[q].keys()) / 10 for q in want]) >= 0.9
    sizes = {r["list"]: r["count"] for r in vector_index.index_rows(spark, at).groupBy("list").count().collect()}
    assert np.mean([sum(sizes.get(li, 0) for li in lists) / 3000 for lists in found.lists.tolist()]) <= 0.2


def test_a_search_reads_the_files_of_its_lists(spark, tmp_path):
    df = spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet")
    vector_index.build(df, str(tmp_path), id_col="vec_id", lists=20)
    found, _ = searched(spark, str(tmp_path), df, [3], probes=2)
    assert len(found.probed) == 2
    read, every = files(found.rows), files(vector_index.index_rows(spark, str(tmp_path)))
    assert {f.split("list=")[1].split("/")[0] for f in read} == set(map(str, found.probed)) and len(read) < 0.3 * len(every)
    told = plan(found.short_list())
    assert "PartitionFilters: [list" in told and "ReadSchema: struct<code:binary,step:double,id:bigint>" in told


def test_vectors_without_a_cosine_and_empty_tables(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [0.9, 0.1]), (None, [0.0, 1.0]), (7, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vector_index.build(df.orderBy(F.col("vec_id").asc_nulls_last()), str(tmp_path / "a"), id_col="vec_id")
    found, got = searched(spark, str(tmp_path / "a"), df, [1, 2, 3, 4, 5], probes=9)
    assert got.keys() == {1} and list(got[1]) == [1, 6, None]
    vector_index.build(df.limit(0), str(tmp_path / "b"), id_col="vec_id")
    assert searched(spark, str(tmp_path / "b"), df, [1])[1] == {}
    assert vector_index.index_rows(spark, str(tmp_path / "b")).count() == 0


def test_codes_keep_a_vector_within_half_a_step():
    g = np.random.default_rng(0)
    for d in (5, 64):
        x = g.normal(size=(100, d))
        codes, step = vector_index.codes_of(x)
        assert codes.shape[1] == (d + 1) // 2
        assert (np.abs(vector_index.from_codes(codes, step, d) - x) <= step[:, None] * 0.5001).all()


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("text"))
    docs = spark.read.parquet(f"{DATA}/sf0.01/conversations.parquet").withColumn("id", F.col("conv_id") * 1000 + F.col("turn")).cache()
    text_index.build(docs, at, buckets=16)
    return text_index.TextIndex(spark, at), docs, at


@pytest.mark.parametrize("query", ["that the other", "th", "a", "", "  ", "...", "50%", "th%er", "x_y the", "und die", "The Thing's", "zzzzqqq", "en and", "ière", " the "])
@pytest.mark.parametrize("threshold", [0.3, 0.05])
def test_results_are_those_of_the_scan(indexed, monkeypatch, query, threshold):
    index, docs, _ = indexed
    monkeypatch.setattr(search, "TRIGRAM_THRESHOLD", threshold)
    want = [(r.id, round(r.similarity, 9)) for r in search.by_text(docs, query, limit=200, order="turn").collect()]
    got = [(r.id, round(r.similarity, 9)) for r in text_index.by_index(index, docs, query, threshold=threshold, limit=200, order="turn").collect()]
    assert got == want


def test_long_queries_and_few_pushed_ids(indexed, monkeypatch):
    index, docs, _ = indexed
    texts = [r.text for r in docs.orderBy("id").limit(40).collect()]
    monkeypatch.setattr(text_index, "PUSHED_IDS", 3)
    for q in [t[5:60] for t in texts[::8]] + [texts[1]]:
        q = q.replace("%", "").replace("_", "").replace("\\", "")
        want = [r.id for r in search.by_text(docs, q, limit=100, order="turn").collect()]
        assert [r.id for r in text_index.by_index(index, docs, q, limit=100, order="turn").collect()] == want and want


def test_a_search_reads_the_buckets_of_its_trigrams(indexed):
    index, docs, at = indexed
    asked = search.query_trigrams(index.spark, "and")
    rows = index.of(index.rows, asked)
    told = plan(rows)
    assert "PartitionFilters: [bucket" in told and "PushedFilters: [In(trigram" in told
    buckets = {f.split("bucket=")[1].split("/")[0] for f in files(rows)}
    assert 1 <= len(buckets) <= len(asked) < 16


def test_the_prefix_filter_leaves_common_trigrams_out(indexed):
    index, docs, _ = indexed
    asked = search.query_trigrams(index.spark, "the and with that zebra")
    may, every = index.like(asked, 0.6).count(), index.of(index.rows, asked).select("id").distinct().count()
    assert may < every / 2


@given(st.text("ab %_'é.", max_size=8), st.text("ab 'é.", max_size=8), st.text("ab 'é.", max_size=8))
def test_sure_trigrams_are_in_every_text_that_holds_the_query(query, before, after):
    held = before + query.replace("%", "b.a").replace("_", "a") + after
    words = "".join(c if text_index._letter(c) else " " for c in held.lower()).split()
    own = {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}
    assert text_index.sure_trigrams(query) <= own


def test_an_empty_text_table(spark, tmp_path):
    docs = spark.createDataFrame([], "id long, text string, chunk_index int")
    text_index.build(docs, str(tmp_path))
    assert text_index.by_index(text_index.TextIndex(spark, str(tmp_path)), docs, "the").collect() == []


def test_first_turn_around_the_middle_wins(spark):
    r = random.Random(4)
    words = [(r.choice(["a", "hot"]), k, s, s + r.choice([0, 0.5, 130])) for k in range(300) for s in [r.uniform(0, 400)]]
    turns = [(r.choice(["a", "hot", None]), k, s, s + r.choice([-1, 0, 5, 61, 300]), r.choice(["x", "y", None])) for k in range(60) for s in [r.uniform(-50, 400)]]
    words += [("none", 900, 1.0, 2.0), ("a", 901, None, 2.0), (None, 902, 1.0, 2.0), ("a", 903, 60.0, 60.0)]
    turns += [("a", 99, 0.0, float("inf"), "endless"), ("a", 98, None, 3.0, "z"), ("a", 97, 60.0, 60.0, "edge")]
    w = spark.createDataFrame(words, "file string, word_id long, start double, end double")
    t = spark.createDataFrame(turns, "file string, turn long, start double, end double, speaker string")
    want = {}
    for f, k, s, e in words:
        mid = None if s is None else (s + e) / 2
        own = [x for x in turns if mid is not None and x[0] == f and f and x[2] is not None and x[3] < float("inf") and x[2] <= mid <= x[3]]
        want[f, k] = min(own, key=lambda x: x[1])[4] if own else None
    for width in (1.0, 60.0):
        df = chunking.speakers_by_midpoint(w, t, "file", width)
        assert {(x.file, x.word_id): x.speaker for x in df.collect()} == want
    joined = plan(df)
    assert "_bucket" in joined and "NestedLoop" not in joined and "Cartesian" not in joined
