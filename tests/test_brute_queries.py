"""Queries that SQL can't express or would be too slow for, against plain Python written from the rules."""

import re
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sonoshelf.functions import text as tx
from sonoshelf.operators import evaluation

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def talks():
    """Words of each conversation as (word, start, end, speaker), in order."""
    out = defaultdict(list)
    for r in pd.read_parquet(f"{SF}/conversations.parquet").itertuples():
        out[r.conv_id] += [(r.turn, k, w, r.turn * 60.0 + k * 0.3, r.turn * 60.0 + k * 0.3 + 0.25, r.role) for k, w in enumerate(x for x in re.split(r"\s+", r.text) if x)]
    return {c: [x[2:] for x in sorted(w)] for c, w in out.items()}


def rows(spark, name):
    return entry.queries()[name](spark, SF).collect()


def segments(words):
    """Cut at gaps of over 0.6 s, other speakers, and after 30 s or 80 words; repeats that overlap go."""
    clean = []
    for w in sorted(words, key=lambda w: (w[1], w[2])):
        if not (clean and clean[-1][0] == w[0] and w[1] < clean[-1][2]):
            clean.append(w)
    out = []
    for w in clean:
        if out:
            last = out[-1]
            full = last[-1][2] - last[0][1] >= 30.0 or len(last) >= 80
            if not full and w[1] - last[-1][2] <= 0.6 and not (w[3] and last[-1][3] and w[3] != last[-1][3]):
                last.append(w)
                continue
        out.append([w])
    return out


def speaker(found):
    n = Counter(x[3] for x in found)
    return max(sorted(n, reverse=True), key=n.get)


def test_words_to_segments(spark, talks):
    want = {(c, k): (" ".join(x[0] for x in s), speaker(s), round(s[0][1], 3), round(s[-1][2], 3)) for c, w in talks.items() for k, s in enumerate(segments(w))}
    got = {(r.conv_id, r.segment): (r.text, r.speaker, pytest.approx(r.start), pytest.approx(r.end)) for r in rows(spark, "words_to_segments")}
    assert got == want


def tokens(text):
    return re.findall(r"\s*(?:\w+|[^\w\s])", text)


def test_segment_chunks(spark, talks):
    want = {}
    for c, w in talks.items():
        chunks, n = [], 0
        for s in segments(w):
            k = len(tokens(" ".join(x[0] for x in s)))
            if not chunks or n + k > 200:
                chunks.append([])
                n = 0
            chunks[-1].append(s)
            n += k
        for i, x in enumerate(chunks):
            want[c, i] = (" ".join(y[0] for s in x for y in s), round(x[0][0][1], 3), round(x[-1][-1][2], 3))
    got = rows(spark, "segment_chunks")
    assert {(r.transcript_id, r.chunk_index): (r.text, pytest.approx(r.start), pytest.approx(r.end)) for r in got} == want
    assert len({r.id for r in got}) == len(got)


def test_window_stitch(spark, talks):
    """Windows of 60 s, 55 s apart: each gives what starts in its core; entries go forward and don't repeat near ones."""
    want = Counter()
    for c, w in talks.items():
        windows = defaultdict(set)
        for word, start, end, _ in w:
            for k in {int(start // 55), max(0, int((start - 5) // 55))}:
                windows[k].add((start - k * 55, word, end - k * 55))
        kept = []
        for k in sorted(windows):
            low, high = 2.5 if k else 0.0, 57.5 if k < max(windows) else float("inf")
            for start, word, end in sorted(windows[k]):
                if not low <= start < high:
                    continue
                at = start + k * 55.0
                if kept and at <= kept[-1][1]:
                    continue
                if any(word == x[0] and at - x[1] <= 0.25 for x in kept[-9:]):
                    continue
                kept.append((word, at, max(at, end + k * 55.0)))
        want.update((str(c), word, round(s, 2), round(e, 2)) for word, s, e in kept)
    assert Counter((r.file, r.word, r.start, r.end) for r in rows(spark, "window_stitch")) == want


def test_overlay_replay(spark):
    want = {}
    for r in pd.read_parquet(f"{SF}/conversations.parquet").itertuples():
        words = [x for x in re.split(r"\s+", r.text) if x]
        placed = sorted(((r.text.find(w), r.text.find(w) + len(w), k, w) for k, w in enumerate(words) if k % 7 == 3 and len(w) > 3), key=lambda x: (-x[0], -x[1], str(x[2])))
        bad = set()
        for a, b in zip(placed, placed[1:], strict=False):
            if b[1] > a[0]:
                bad |= {a[2], b[2]}
        text = r.text
        for start, end, k, w in placed:
            if k not in bad:
                text = text[:start] + w.upper() + text[end:]
        want[r.conv_id, r.turn] = (text, len(placed) - len(bad), len(bad))
    assert {(r.transcript_id, r.chunk_index): (r.text, r.applied, r.stale) for r in rows(spark, "overlay_replay")} == want


def test_manual_edits(spark):
    want = {}
    for r in pd.read_parquet(f"{SF}/conversations.parquet").itertuples():
        words = [x for x in re.split(r"\s+", r.text) if x]
        number = [r.conv_id * 100_000 + r.turn * 1000 + k for k in range(len(words))]
        if not words:
            continue
        other = [(n, w) for k, (n, w) in enumerate(zip(number, words, strict=True)) if k % 7 == 0 and n % 2 == 0]
        span, places = words[0], [m.start() for m in re.finditer(f"(?={re.escape(words[0])})", r.text)]
        if number[0] % 5 == 0 and len(places) > 1:
            want[number[0]] = ("ambiguous",)
            continue
        fits = sorted(((r.text.find(w), r.text.find(w) + len(w), str(n), w) for n, w in other if n % 3), key=lambda x: (-x[0], -x[1], x[2]))
        bad = {y for a, b in zip(fits, fits[1:], strict=False) if b[1] > a[0] for y in (a, b)}
        fits, gone = [x for x in fits if x not in bad], len(bad) + sum(n % 3 == 0 for n, _ in other)
        at, end = places[0], places[0] + len(span)
        if any(s < end and at < e for s, e, *_ in fits):
            want[number[0]] = ("overlap",)
            continue
        text = r.text
        again = sorted([*[(r.text.find(w), r.text.find(w) + len(w), str(n), w) for n, w in other if n % 3], (at, end, str(number[0]), span)], key=lambda x: (-x[0], -x[1], x[2]))
        bad = {y for a, b in zip(again, again[1:], strict=False) if b[1] > a[0] for y in (a, b)}
        for s, e, _, w in again:
            if (s, e, _, w) not in bad:
                text = text[:s] + w.upper() + text[e:]
        want[number[0]] = ("ok", at, 0, text, gone)
    got = rows(spark, "manual_edits")
    assert {r.id: (r.status, r.start, r.occurrence, r.preview, r.stale) if r.status == "ok" else (r.status,) for r in got} == want
    assert {x[0] for x in want.values()} == {"ok", "overlap", "ambiguous"}
    for r in got:
        done = r.status == "ok"
        assert r.embedding_stale == done and (r.model, r.origin, r.patch_state, r.confidence) == (("manual", "human", "accepted", 1.0) if done else (None,) * 4) and r.anchor_offset == r.start
        assert not done or r.suggested_correction == r.original_text.upper()


def test_token_chunks(spark):
    want = {}
    for r in pd.read_parquet(f"{SF}/conversations.parquet").itertuples():
        t = tokens(r.text)
        for k in range(0, max(1, len(t)), 64):
            want[r.conv_id, r.turn, k // 64] = "".join(t[k : k + 64]).strip()
    assert {(r.conv_id, r.turn, r.pos): r.chunk for r in rows(spark, "token_chunks")} == want


SPACE = " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def cut(text, query, most):
    if len(text) <= most:
        return text
    at = text.lower().find(query.lower()) if query else -1
    start = max(0, at - int((most - len(query)) / 2)) if at >= 0 else 0
    start = min(start, len(text) - most)
    end = start + most
    if start:
        while start < end and text[start] != " ":
            start += 1
        while start < end and text[start] == " ":
            start += 1
    if end < len(text):
        while end > start and text[end - 1] != " ":
            end -= 1
    if start >= end:
        start, end = 0, most
    return "…" * (start > 0) + text[start:end].strip(SPACE) + "…" * (end < len(text))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_snippets(spark, sf):
    at = f"/root/testdata/{sf}"
    want = {i: cut(t, "the", 120) for i, t in pd.read_parquet(f"{at}/documents.parquet")[["doc_id", "text"]].itertuples(index=False, name=None)}
    assert {r.doc_id: r.snippet for r in entry.queries()["snippet_text"](spark, at).collect()} == want


@pytest.mark.parametrize("query", ["the", "", None, "B", "end", "x" * 50, "zz"])
@pytest.mark.parametrize("most", [1, 10, 40])
def test_odd_snippets(spark, query, most):
    texts = ["", "a", "the end", "x" * 200, "x" * 60 + " the " + "y" * 60, "a\nb\tc " * 20, "  lead" * 10, "word " * 30 + "end", "\u3000wide\u3000" * 12, " " * 100, "é the ü " * 20, "x" * 35 + "\nthe " + "b c " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.s for r in df.select("i", tx.snippet(F.col("t"), query, most).alias("s")).collect()}
    assert got == {i: cut(t, query or "", most) for i, t in enumerate(texts)}


def test_eval_sample(spark):
    got = rows(spark, "eval_sample")
    assert len(got) == len({r.id for r in got}) == evaluation.SAMPLE_LIMIT and all(r.job_id == r.id // 1000 * 2 for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, rows(spark, "eval_sample")))
    c = spark.createDataFrame([(i, 1, i, "p", "t") for i in range(300)], "id long, transcript_id long, chunk_index int, file_path string, text string")
    t = spark.createDataFrame([(1, 2)], "id long, job_id long")
    pick = lambda df, seed: {r.id for r in evaluation.sample(df, t, 20, seed).collect()}
    assert pick(c, 1) == pick(c.repartition(7), 1) != pick(c, 2)


def test_judge_run(spark):
    want = set()
    for r in pd.read_parquet(f"{SF}/conversations.parquet").itertuples():
        w = r.text.split()
        said = next((a for a, b in zip(w, w[1:], strict=False) if a == b and '"' not in a and "\\" not in a), None)
        if said and re.sub(r"[\W_]+", "", said):
            want.add((r.conv_id, r.turn, f"{said} {said}", "repeated_text", said, 0.9, "proposed"))
    got = rows(spark, "judge_run")
    assert {(r.transcript_id, r.chunk_index, r.original_text, r.issue_type, r.suggested_correction, r.confidence, r.patch_state) for r in got} == want and len(got) == len(want)


def test_process_transcripts(spark, talks):
    got = rows(spark, "process_transcripts")
    assert len(got) == sum(1 for _ in rows(spark, "segment_chunks")) and {r.dims for r in got} == {64}
    shorter = [r for r in got if r.after < r.before]
    assert 0 < len(shorter) <= got[0].applied and all(r.after <= r.before for r in got)


def test_resegment_backfill(spark, talks):
    (r,) = rows(spark, "resegment_backfill")
    n = [len(segments(w)) for w in talks.values()]
    changed = sum(x != 1 for x in n)
    assert (r.transcripts, r.changed, r.written, r.skipped_empty, r.segments_before, r.segments_after) == (len(n), changed, changed, 0, len(n), sum(n))


def test_an_empty_result_never_replaces_segments(spark):
    kind = "id long, segments array<struct<id:int,start:double,end:double,text:string,speaker:string,words:array<struct<word:string,start:double,end:double,speaker:string>>>>"
    df = spark.createDataFrame([(1, [(0, 0.0, 1.0, "lost", None, None)]), (2, [(0, 0.0, 9.0, "a b", None, [("a", 0.0, 1.0, None), ("b", 8.0, 9.0, None)])])], kind)
    after, counts = evaluation.resegmented(df, apply=True)
    assert {r.id: [s.text for s in r.segments] for r in after.collect()} == {1: ["lost"], 2: ["a", "b"]}
    assert counts.first().asDict() == {"transcripts": 2, "changed": 1, "written": 1, "skipped_empty": 1, "segments_before": 2, "segments_after": 3}
    dry, counts = evaluation.resegmented(df)
    assert {r.id: len(r.segments) for r in dry.collect()} == {1: 1, 2: 1} and counts.first().written == 0


def test_text_topk_documents(spark):
    grams = lambda t: {x[i : i + 3] for w in re.findall(r"[^\W_]+", t.lower()) for x in [f"  {w} "] for i in range(len(x) - 2)}
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    asked = pd.read_parquet(f"{SF}/benchmark.parquet").set_index("item_id").loc[1, "text"]
    q, best = grams(asked), []
    for r in docs.itertuples():
        t = grams(r.text)
        s = len(q & t) / len(q | t)
        if s >= 0.3 or asked.lower() in r.text.lower():
            best.append((-s, r.n_chars, r.doc_id))
    got = [(r.doc_id, r.similarity) for r in rows(spark, "text_topk_documents")]
    assert got == [(i, pytest.approx(-s, abs=1e-6)) for s, _, i in sorted(best)[:20]]


def test_embedder_prefixes_and_counts(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string")
    seen = evaluation.embedded(df, lambda texts: [[float(len(t)), float(t.startswith("search_document: "))] for t in texts], "nomic-embed").orderBy("id").collect()
    assert [list(r.embedding) for r in seen] == [[20.0, 1.0], [17.0, 1.0]]
    assert evaluation.query_vector("x", lambda t: [[float(len(t[0]))]], "Nomic") == [15.0] and evaluation.query_vector("x", lambda t: [[float(len(t[0]))]], "other") == [1.0]
    with pytest.raises(Exception, match="gave 1 vectors"):
        evaluation.embedded(df.coalesce(1), lambda texts: [[1.0]]).collect()


def test_one_book_is_meant_or_an_error_lists_them(spark):
    from sonoshelf.operators import service

    books = spark.createDataFrame([("lib/a [B0ABCDEFGH]", "George Orwell", "1984"), ("lib/b [1984832069]", "D. Kahneman", "Noise [1984832069]"), ("lib/c", "George Orwell", "Animal Farm")], "book_dir string, author string, title string")
    assert service.resolve_book(books, "1984") == "lib/a [B0ABCDEFGH]"
    assert service.resolve_book(books, "anything [1984832069]") == "lib/b [1984832069]" and service.resolve_book(books, "[b0abcdefgh]") == "lib/a [B0ABCDEFGH]"
    with pytest.raises(LookupError, match="2 books"):
        service.resolve_book(books, "george")
    with pytest.raises(LookupError, match="no book"):
        service.resolve_book(books, "nobody")
