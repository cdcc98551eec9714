import base64
import hashlib
import random
from collections import defaultdict
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from sonoshelf.llm import exact_dedup, mixing, warc
from sonoshelf.llm.common import new_path, stow, temporary

TEXTS = ["a", "b", "a", None, "", "A", " a", "x" * 40_000, "x" * 40_000, "c"] + ["hot"] * 40


@pytest.mark.parametrize("keep", ["max", "min"])
def test_copies_are_those_of_brute_force(spark, keep):
    docs = spark.createDataFrame([(i, t, "s", True) for i, t in enumerate(TEXTS)], "doc_id long, text string, h string, kept boolean")
    groups = defaultdict(list)
    for i, t in enumerate(TEXTS):
        groups[t or ""].append(i)
    best = max if keep == "max" else min
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.copy_key, r.h) for r in exact_dedup.mark_copies(docs, keep=keep).collect())
    assert got == [(i, best(groups[t or ""]), len(groups[t or ""]), i == best(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest(), "s") for i, t in enumerate(TEXTS)]
    one = exact_dedup.keep_one(docs, keep=keep)
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.collect()) == sorted(map(best, groups.values()))


def test_a_filter_too_small_changes_nothing(spark):
    rows = [(i, f"text {i % 4000}") for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert exact_dedup.mark_copies(docs, max_blocks=1).where("group_size = 2").count() == 2000


def test_a_filter_beyond_its_bound_gives_what_one_within_does(spark):
    docs = spark.createDataFrame([(i, f"text {i % 4000}") for i in range(5000)] + [(7, "text 7")] + [(9000 + i, "hot") for i in range(1000)], "doc_id long, text string")
    copies = exact_dedup.Copies(docs, "doc_id", "text", "max", 1)
    assert copies.blocks == 3 and copies.marks == 1
    assert copies.suspects().count() < 3200
    for f in (exact_dedup.decide, exact_dedup.mark_copies, exact_dedup.keep_one):
        assert sorted(map(tuple, f(docs, max_blocks=1).collect())) == sorted(map(tuple, f(docs).collect()))
    assert exact_dedup.keep_one(docs, max_blocks=1).count() == 4001


def test_a_filter_that_is_full_drops_nothing(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BITS_AN_ENTRY", 0)  # one block for all
    docs = spark.createDataFrame([(i, f"text {i % 60_000}") for i in range(120_000)], "doc_id long, text string")
    told = exact_dedup.decide(docs)
    assert told.count() == 120_000 and told.where("group_size = 2 and kept = (doc_id >= 60000)").count() == 120_000


@pytest.mark.parametrize("rows", [3000, 60_000])
def test_texts_are_scanned_as_often_whatever_the_filters_size(spark, tmp_path, rows):
    at = str(tmp_path / "docs")
    spark.range(rows).selectExpr("id as doc_id", f"concat('t', id % {rows - 500}) as text").write.parquet(at)
    docs = spark.read.parquet(at)
    for f, scans in ((exact_dedup.keep_one, 2), (exact_dedup.mark_copies, 2), (exact_dedup.decide, 0)):
        out = f(docs, max_blocks=1)
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [doc_id") == scans
        assert out.count() == (rows - 500 if f is exact_dedup.keep_one else rows)


def test_columns_named_like_results_or_helpers_stay_as_they_are(spark):
    schema = "doc_id long, text string, kept string, keep_id string, group_size string, copy_key string, keep_rows string, h string, _key string, _of string, id string, Block string"
    docs = spark.createDataFrame([(i, "same" if i < 3 else str(i), *[f"{c}{i}" for c in "abcdefghij"]) for i in range(5)], schema)
    assert sorted(map(tuple, exact_dedup.keep_one(docs).collect())) == sorted(map(tuple, docs.where("doc_id >= 2").collect()))
    marked = exact_dedup.mark_copies(docs)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.h, r.Block) for r in marked.collect()) == [(0, 2, 3, False, "f0", "j0"), (1, 2, 3, False, "f1", "j1"), (2, 2, 3, True, "f2", "j2"), (3, 3, 1, True, "f3", "j3"), (4, 4, 1, True, "f4", "j4")]
    assert exact_dedup.decide(docs).count() == 5


def test_what_is_written_in_a_temporary_block_is_removed(spark):
    df = spark.range(3)
    with temporary(spark):
        with temporary(spark):
            inner, outer = stow(df, "inner"), stow(df, "outer", outlives=True)
        assert outer.count() == 3
        at = [Path(urlparse(x.inputFiles()[0]).path).parent for x in (outer,)]
    assert not at[0].exists()
    with pytest.raises(Exception, match="FILE|exist"):
        inner.collect()


def test_an_empty_block_inside_another_takes_nothing_from_it(spark):
    with temporary(spark):
        with temporary(spark):
            pass
        at = Path(urlparse(stow(spark.range(3), "later").inputFiles()[0]).path).parent
        assert at.exists()
    assert not at.exists()


def test_rows_without_copies_are_not_shuffled(spark, tmp_path):
    at = str(tmp_path / "docs")
    spark.range(2000).selectExpr("id as doc_id", "concat('t', id) as text").write.parquet(at)
    plan = exact_dedup.mark_copies(spark.read.parquet(at))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    union = plan[plan.index("Union") :]
    first = union[: union.index("Scan parquet [doc_id")]  # the branch up to its scan of the texts
    assert "Exchange hashpartitioning" not in first and "BroadcastHashJoin" in first


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    assert {(r.keep_id, r.group_size) for r in exact_dedup.mark_copies(docs).where("text = 'a'").collect()} == {(1, 3)}
    assert sorted(map(tuple, exact_dedup.keep_one(docs).collect()), key=repr) == [(1, "a"), (None, "b")]
    assert exact_dedup.mark_copies(docs.limit(0)).collect() == []


def test_mix_meets_its_targets_and_repeats(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randint(0, 30)), ["a", "b", "c", "d", None, "tiny"][r.choice([0, 0, 0, 1, 2, 3, 4])], 7) for i in range(3000)]
    rows += [(9000 + i, "one two", "tiny", 7) for i in range(5)] + [(9100, None, "empty", 7), (9101, "", "empty", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, source = {i: len((t or "").split()) for i, t, *_ in rows}, {i: s for i, _, s, _ in rows}
    total, by = sum(sizes.values()), defaultdict(int)
    for i, n in sizes.items():
        by[source[i]] += n
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    full, target = set(), {}
    while True:
        left, w = total - sum(3 * by[s] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: 3 * by[s] if s in full else left * weight[s] / w for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * by[s]}
        if not over:
            break
        full |= over
    taken = defaultdict(int)
    for x in got:
        assert (x.size, x.source_size) == (sizes[x.doc_id], by[source[x.doc_id]])
        assert x.target == pytest.approx(target[source[x.doc_id]])
        assert 0 <= x.taken <= 3 * x.size and (x.size == 0 or x.taken % x.size == 0)
        taken[source[x.doc_id]] += x.taken
    assert all(abs(taken[s] - target[s]) <= 15 for s in order)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    mixed = mixing.take(docs)
    assert mixed.columns == docs.columns
    words = mixed.groupBy("source").agg({"text": "count"}).count()
    assert words >= 5
    assert mixed.selectExpr("sum(size(filter(split(text, ' '), x -> x <> '')))").first()[0] == sum(taken.values())


def test_mix_of_an_empty_table_and_of_repeated_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).collect() == [] and mixing.take(empty).collect() == []
    docs = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", "t")], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 3


TRICK = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nfive!\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99999\r\n\r\nend WARC/1.1\r\n"


def test_archives_give_back_every_page(spark):
    pages = [(i, f"http://h/{i}", f"<p>é {i}</p>") for i in range(60)]
    pages += [(70, "u", TRICK), (71, "u\r\nX: y", TRICK), (72, None, None), (73, "u", ""), (74, "u", "WARC/1.1\r\n"), (75, "u", TRICK * 50 + "z" * 100_000)]
    pages += [(80 + i, "u", "same") for i in range(9)] + [(79, "u", "same")]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in pages], "page_id long, url string, html string, block string")
    at = new_path(spark, "warc")
    warc.write_archives(df.repartition(3), at)
    got = {r.page_id: r for r in warc.read_archives(spark, at).collect()}
    first = {}
    for i, _, h in sorted(pages, key=lambda p: p[0]):
        first.setdefault(h or "", i)
    assert len(got) == len(pages)
    for i, _, h in pages:
        raw, r = (h or "").encode(), got[i]
        assert r.payload_bytes == len(raw), i
        assert r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))
    assert got[71].url == "u%0D%0AX: y"


def test_torn_records_come_back_when_the_scans_are_split_differently(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", TRICK + str(i % 7) + "y" * (i * 37 % 900)) for i in range(80)], "page_id long, url string, html string")
    at = new_path(spark, "warc")
    warc.write_archives(pages.coalesce(2), at)
    lines, calls = warc._lines, []

    def other_splits(*args):
        calls.append(1)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(2000 + 1777 * len(calls)))
        return lines(*args)

    monkeypatch.setattr(warc, "_lines", other_splits)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        got = {r.page_id: r.payload_digest for r in warc.read_archives(spark, at).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(calls) == 2
    assert got == {r.page_id: base64.b32encode(hashlib.sha1(r.html.encode()).digest()).decode() for r in pages.collect()}


def test_archives_split_in_small_pieces_read_the_same(spark):
    pages = spark.createDataFrame([(i, "u", TRICK + str(i) + "y" * (i * 37 % 900)) for i in range(80)], "page_id long, url string, html string")
    at = new_path(spark, "warc")
    warc.write_archives(pages.coalesce(1), at)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = {r.page_id: r.payload_bytes for r in warc.read_archives(spark, at).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {r.page_id: len(r.html.encode()) for r in pages.collect()}


def test_repeated_pages_null_ids_and_an_empty_table(spark):
    pages = spark.createDataFrame([(5, "u", "a"), (5, "u", "a"), (None, "u", "a"), (None, "u", "b")], "page_id long, url string, html string")
    at = new_path(spark, "warc")
    warc.write_archives(pages, at)
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(spark, at).collect()), key=repr)
    assert got == [(5, "response", None), (5, "revisit", 5), (None, "response", None), (None, "revisit", 5)]
    at = new_path(spark, "warc")
    warc.write_archives(pages.limit(0), at)
    assert warc.read_archives(spark, at).collect() == []
