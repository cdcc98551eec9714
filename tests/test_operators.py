"""Column expressions and table operators on small frames."""

import json

import pytest
from pyspark.sql import functions as F

from sonoshelf.functions import text as tx
from sonoshelf.operators import chunking, findings, library, overlay, pipeline, search, vector
from sonoshelf.sources import readers


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (tx.book_dir, "a/b/c.mp3", "a/b"), (tx.book_dir, "c.mp3", "c.mp3"), (tx.basename, "a/b/c.mp3", "c.mp3"), (tx.extension, "a/b.X/c.Mp3", "mp3"),
        (tx.is_audio_file, "x/a.M4B", True), (tx.is_audio_file, "x/._a.mp3", False), (tx.is_audio_file, "x/a.txt", False), (tx.word_count, "  a  b ", 2), (tx.word_count, "", 0),
        (tx.asin, "T [b0abcdefgh]", "B0ABCDEFGH"), (tx.asin, "T [1984832069]", "1984832069"), (tx.asin, "T [12]", None), (tx.without_asin, "T [B0ABCDEFGH]", "T"),
        (tx.title_from_path, "a/My Book - Chapter 12.mp3", "My Book"), (tx.title_from_path, "My Book - CD2.mp3", "My Book"), (tx.title_from_path, "a/03.mp3", "03"), (tx.title_from_path, "Saga – Disc 4.m4b", "Saga"),
        (tx.title_from_path, "Saga_vol 4", "Saga"), (tx.title_from_path, "Saga Volume 12 .mp3", "Saga"), (tx.title_from_path, ".hidden", ".hidden"), (tx.title_from_path, "Plain.v2.mp3", "Plain.v"), (tx.normalised, "  It's — Ünder! ", "it s ünder"), (tx.outer_json, 'x {"a": {}} y', '{"a": {}}'), (tx.outer_json, "none", ""),
        (tx.sanitised, "a\tb\x00", "a b"), (tx.model_size, "qwen2.5-0.6b-x", "0.6B"), (tx.model_size, "none", None),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("Dune #2, The Dune Sequence #13", [("Dune", "2"), ("The Dune Sequence", "13")]), ("Foundation#3", [("Foundation", "3")]), ("X #1.5", [("X", "1.5")]), ("Discworld #1-3", [("Discworld", "1-3")]),
        ("A #1,", [("A", "1")]), ("#7", None), ("", None), ("Plain", [("Plain", "")]),
    ],
)
def test_series(spark, value, want):
    got = one(spark, value, tx.series_refs)
    assert (got and [tuple(x) for x in got]) == want


def test_sequences_sort_numbers_first_and_empty_last(spark):
    df = spark.createDataFrame([(s,) for s in ["", "10", "2", "1.5", "1-3", "b"]], "s string")
    assert [r.s for r in df.orderBy(*tx.sequence_order(F.col("s"))).collect()] == ["1.5", "2", "10", "1-3", "b", ""]


def test_trigrams_and_search(spark):
    df = spark.createDataFrame([(1, 0, "the quick brown fox"), (2, 1, "quick brown"), (3, 2, "100% sure"), (4, 3, "nothing here")], "id long, chunk_index int, text string")
    assert set(one(spark, "cat", tx.trigrams)) == {"  c", " ca", "cat", "at "}
    assert [r.id for r in search.by_text(df, "quick brown").collect()] == [2, 1]
    assert [r.id for r in search.by_text(df, "no%here").collect()] == [4]
    assert [r.id for r in search.by_index(search.trigram_index(df), "quick brown", 0.5).orderBy("id").collect()] == [1, 2]
    assert search.by_index(search.trigram_index(df), "!!").count() == 0
    assert df.where(tx.contains_exact(F.col("text"), "100%")).count() == 1 and df.where(F.col("text").ilike("%" + tx.like_escape("0%") + "%")).count() == 1


def test_totals_have_no_broadcast_of_unknown_size(spark):
    c = spark.createDataFrame([(1, 0, "the"), (1, 1, "x"), (2, 0, "y"), (3, 0, "the"), (None, 0, "the"), (None, 1, "z")], "conv_id long, turn int, text string")
    out = search.with_totals(c.where("text = 'the'"), c, "conv_id")
    assert sorted(((r.conv_id, r.total_chunks) for r in out.collect()), key=repr) == [(1, 2), (3, 1), (None, None)]
    assert "strategy=broadcast" not in out._jdf.queryExecution().analyzed().toString()


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0]), (6, None)], "id long, embedding array<float>")
    got = [(r.id, round(r.similarity, 4)) for r in search.similar(df, [1.0, 0.0]).collect()]
    assert got == [(1, 1.0), (2, 0.6), (3, 0.0)]
    assert [r.id for r in search.similar(df, [1.0, 0.0], threshold=0.3, scope=F.col("id") > 1).collect()] == [2]
    assert search.similar(df, [1.0, 0.0], limit=5000)._jdf.queryExecution().optimizedPlan().toString().count("10") >= 1
    with pytest.raises(ValueError):
        vector.vector_of(df, "id", 99)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_the_registered_bucket_search(spark, sf):
    v = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    hit = 0
    for i in range(0, 100, 10):
        q = vector.vector_of(v, "vec_id", i)
        exact = {r.vec_id for r in search.similar(v, q, id_col="vec_id").collect()}
        hit += len(exact & {r.vec_id for r in search.near_by_buckets(v, q, id_col="vec_id").collect()})
    assert hit / 100 >= 0.9


def test_snippets(spark):
    long = "alpha " * 50 + "needle " + "omega " * 50
    got = one(spark, long, lambda c: tx.snippet(c, "NEEDLE", 80))
    assert "needle" in got and got.startswith("…") and got.endswith("…") and len(got) <= 82
    assert one(spark, "short", lambda c: tx.snippet(c, "x", 80)) == "short"


def test_chapters(spark):
    ch = [(0, "a", 0.0, 17.18), (1, "b", 17.18, 2221.01), (2, "c", 2221.01, 3942.49)]
    df = spark.createDataFrame([(ch,)], "c array<struct<index:int,title:string,start_sec:double,end_sec:double>>")
    at = lambda t: df.select(library.chapter_at(F.col("c"), F.lit(t))["index"]).first()[0]
    assert [at(x) for x in (0.0, 17.17, 17.18, 3942.49, 3942.6, -1.0)] == [0, 0, 1, 2, None, None]


def test_offsets_are_unknown_after_an_unknown_duration(spark):
    df = spark.createDataFrame([("b", "1", 10.0), ("b", "2", None), ("b", "3", 5.0), ("c", "1", 4.0), ("c", "2", 6.0), ("c", "3", float("nan")), ("c", "4", 1.0)], "d string, p string, s double")
    got = [(r.d, r.p, r.offset) for r in library.track_offsets(df, "d", "p", "s").orderBy("d", "p").collect()]
    assert got == [("b", "1", 0.0), ("b", "2", 10.0), ("b", "3", None), ("c", "1", 0.0), ("c", "2", 4.0), ("c", "3", 10.0), ("c", "4", None)]


def test_book_pages(spark):
    jobs = spark.createDataFrame([(i, f"lib/b{i % 3}/t{i}.mp3", ["done", "pending", "claimed"][i % 3 if i > 5 else 0], i) for i in range(12)], "id long, file_path string, status string, updated_at int")
    metrics = spark.createDataFrame([(i, 100, 10) for i in range(5)], "job_id long, duration_seconds long, word_count long")
    meta = spark.createDataFrame([("lib/b0", "Zero", "Ann", "S #1")], "book_dir string, title string, author string, series string")
    page = library.book_summaries(jobs, metrics, meta, limit=2, offset=1)
    assert [(r.book_dir, r.matching) for r in page.collect()] == [("lib/b2", 3), ("lib/b1", 3)]
    assert library.book_summaries(jobs, metrics, meta, offset=9).collect() == []
    assert [r.book_dir for r in library.book_summaries(jobs, metrics, meta, status="complete").collect()] == ["lib/b0"]
    assert [r.title for r in library.book_summaries(jobs, metrics, meta, query="z_ro").collect()] == ["Zero"]
    for bad in ({"sort": "x"}, {"status": "x"}):
        with pytest.raises(ValueError):
            library.book_summaries(jobs, metrics, meta, **bad)


def test_disjoint_batches_and_recovery(spark):
    t = spark.createDataFrame([(i, i) for i in range(10)], "id long, created_at int")
    e, c = t.where("id % 2 = 0").select("id"), t.where("id % 3 = 0").select("id")
    a, b = pipeline.next_batch(t, e, c, want_evaluated=True), pipeline.next_batch(t, e, c, want_evaluated=False)
    assert a.intersect(b).count() == 0 and a.union(b).count() == 6
    jobs = spark.sql("select 1 id, 'claimed' status, timestamp'2024-01-01 00:00:00' updated_at, 1 attempts union all select 2, 'claimed', timestamp'2024-01-01 00:00:00', 3 union all select 3, 'claimed', timestamp'2024-01-01 00:50:00', 0")
    jobs = jobs.withColumns({"claimed_by": F.lit("r"), "claimed_at": F.col("updated_at"), "file_path": F.concat(F.lit("p"), "id")})
    after = pipeline.recovered(jobs, F.lit("2024-01-01 01:00:00").cast("timestamp"))
    got = {r.id: (r.status, r.stale, r.claimed_by, r.claimed_at is None, r.error) for r in after.collect()}
    assert got == {1: ("pending", True, None, True, None), 2: ("failed", True, "r", False, "max attempts reached"), 3: ("claimed", False, "r", False, None)}
    told = {r.job_id: (r.file_path, r.attempt, r.stage, r.event, r.runner_host) for r in pipeline.recovery_events(after).collect()}
    assert told == {1: ("p1", 1, "requeue", "retry", "go-worker"), 2: ("p2", 3, "fail", "error", "go-worker")}


@pytest.mark.parametrize(("rates", "share", "want"), [((7.0, 0.5, 1.0), 0.5, (850.0, 1700.0)), ((7.0, 0.5, 1.0), 0.0, (850.0, None)), ((7.0, 0.5, 1.0), 2.5, (850.0, 850.0)), ((float("nan"), float("inf"), 1.0), 1.0, (100.0, 100.0))])
def test_time_left(spark, rates, share, want):
    df = spark.createDataFrame([(100, *rates, share)], "chunks long, transcribe double, embed double, evaluate double, available double")
    r = pipeline.time_left(df).first()
    assert (r.work, r.calendar) == want
    assert pipeline.time_left(df.withColumn("chunks", F.lit(-5))).first().work == 0


def test_or_join_has_no_nested_loop(spark):
    chunks = spark.createDataFrame([(1, 10, 0, "a"), (2, 10, 1, "b")], "id long, transcript_id long, chunk_index int, text string")
    found = spark.createDataFrame([(1, 1, 10, 1), (2, None, 10, 1), (3, 9, 10, 0), (4, None, 11, 0)], "id long, chunk_id long, transcript_id long, chunk_index int")
    out = findings.with_chunk(found, chunks)
    assert {r.id: r.chunk_text for r in out.collect()} == {1: "a", 2: "b", 3: None, 4: None}
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_judgements(spark):
    raw = "noise " + json.dumps({"findings": [
        {"original_text": " teh ", "suggested_correction": "the", "issue_type": " Misheard_Word", "confidence": 1.7, "anchor_offset": -3, "anchor_occurrence": 0}, {"original_text": "Same", "suggested_correction": "same!", "issue_type": "x", "confidence": 0.5},
        {"original_text": "a", "suggested_correction": "b", "issue_type": "weird", "confidence": -1, "anchor_offset": 4}, {"original_text": "c", "suggested_correction": " "}, {"suggested_correction": "d"},
    ]}) + " end"
    got = [tuple(x) for x in one(spark, raw, findings.parse_judgement)]
    assert got == [("teh", "misheard_word", "the", 1.0, None, 0), ("a", "other", "b", 0.0, 4, None)]
    assert one(spark, '{"findings": []}', findings.parse_judgement) == [] == one(spark, "{}", findings.parse_judgement)
    assert one(spark, "no json", findings.parse_judgement) is None


def test_corrected_chunks(spark):
    chunks = spark.createDataFrame([(1, 0, "the fox ran"), (1, 1, "plain"), (2, 0, "fox fox")], "transcript_id long, chunk_index int, text string")
    sha = overlay.text_hash
    patches = spark.createDataFrame(
        [(1, 0, 5, "fox", "dog", sha("the fox ran"), None, None), (2, 0, 6, "fox", "cat", sha("fox fox"), 4, None), (2, 0, 7, "fox", "cow", "bad", 0, None), (9, 9, 8, "x", "y", "", None, None)],
        "transcript_id long, chunk_index int, id long, span string, correction string, sha256 string, offset int, occurrence int",
    )
    got = {(r.transcript_id, r.chunk_index): (r.text, r.applied, r.stale) for r in overlay.corrected(chunks, patches).collect()}
    assert got == {(1, 0): ("the dog ran", [5], {}), (1, 1): ("plain", [], {}), (2, 0): ("fox cat", [6], {7: "text changed"})}
    assert [r.id for r in overlay.orphans(chunks, patches).collect()] == [8]
    told = overlay.outcomes(overlay.corrected(chunks, patches), chunks, patches)
    assert sorted(map(tuple, told.collect())) == [(5, "applied", None), (6, "applied", None), (7, "stale", "text changed"), (8, "stale", "chunk gone")]


def test_native_chunks(spark):
    assert one(spark, "hello", lambda c: chunking.char_chunks(c, 3)) == ["hel", "lo"]
    assert one(spark, "你好世界", lambda c: chunking.char_chunks(c, 2)) == ["你好", "世界"]
    assert one(spark, "", lambda c: chunking.char_chunks(c, 3)) == []
    assert one(spark, "a  b. c", lambda c: chunking.word_chunks(c, 2)) == ["a b.", "c"]


def test_windows_stitch_to_one_line_of_time(spark):
    rows = [("f", 0, [("a", 1.0, 2.0), ("b", 590.0, 591.0), ("late", 594.0, 595.0)]), ("f", 1, [("early", 3.0, 4.0), ("b", 7.6, 8.0), ("c", 20.0, 19.0)])]
    df = spark.createDataFrame(rows, "file string, window int, words array<struct<word:string,start:double,end:double>>")
    got = [(r.word, r.start, r.end) for r in chunking.stitch(df).orderBy("start").collect()]
    near = spark.createDataFrame([("f", 0, [("a", 1.0, 1.1), ("b", 1.1, 1.2), ("a", 1.2, 1.3), ("c", 9.0, 9.1)])], df.schema)
    assert [r.word for r in chunking.stitch(near).orderBy("start").collect()] == ["a", "b", "c"]
    assert got == [("a", 1.0, 2.0), ("b", 590.0, 591.0), ("b", 592.6, 593.0), ("c", 605.0, 605.0)]


def test_sources(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for name in ("a.mp3", "._a.mp3", "b.txt"):
        (tmp_path / "x" / name).write_bytes(b"abc")
    (r,) = readers.audio_files(spark, str(tmp_path), checksum=True).collect()
    assert r.path.endswith("x/a.mp3") and r.length == 3 and r.sha256.startswith("ba7816bf")
    (tmp_path / "x" / "metadata.json").write_text(json.dumps({"title": "T", "authors": [{"name": "A"}], "isbn": 9.78e12, "asin": "b0x"}))
    (m,) = readers.sidecars(spark, str(tmp_path)).collect()
    assert (m.title, m.author, m.isbn, m.asin) == ("T", "A", "9780000000000", "B0X")
    (tmp_path / "c.json").write_text(json.dumps({"results": [{"asin": "b01", "title": "x", "author": "y", "chapters": []}]}))
    assert readers.catalogue_items(spark, str(tmp_path / "c.json")).first().asin == "B01"
    base = spark.createDataFrame([("d1",), ("d2",)], "book_dir string")
    kind = f"book_dir string, title string, author string, chapters {readers.CHAPTERS}"
    p1, p2 = spark.createDataFrame([("d1", "", "", [])], kind), spark.createDataFrame([("d1", "T1", "", []), ("d2", "T2", "A2", [])], kind)
    assert {r.book_dir: r.title for r in readers.first_found(base, "book_dir", [p1, p2]).collect()} == {"d1": "T1", "d2": "T2"}


def test_broken_json_is_an_error(spark):
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        spark.createDataFrame([("{bad",)], "v string").select(readers.decoded(F.col("v"), "struct<a:int>")).collect()
