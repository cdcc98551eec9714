"""The sequential kernels, against the golden cases of the library they re-create."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sonoshelf.operators import chunking, findings, overlay


def patch(i, span, correction, text, offset=None, occurrence=None, sha=None):
    return {"id": i, "span": span, "correction": correction, "sha256": overlay.text_hash(text) if sha is None else sha, "offset": offset, "occurrence": occurrence}


TEXT = "the fox ran and the fox sat"


@pytest.mark.parametrize(
    ("how", "want"),
    [
        ({"span": "fox", "offset": 20}, (20, "offset")), ({"span": "fox", "offset": 21, "occurrence": 1}, (20, "occurrence")), ({"span": "fox", "occurrence": 0}, (4, "occurrence")), ({"span": "fox", "occurrence": -1}, (None, "ambiguous")), ({"span": "ran", "offset": 3}, (8, "unique")),
        ({"span": "fox"}, (None, "ambiguous")), ({"span": "cat"}, (None, "not found")), ({"span": "fox", "occurrence": 3}, (None, "ambiguous")), ({"span": ""}, (None, "not found")),
    ],
)
def test_locate(how, want):
    assert overlay.locate(TEXT, **how) == want
    assert overlay.locate("é世" + TEXT, "ran") == (10, "unique")
    assert overlay.locate("aaa", "aa") == (None, "ambiguous") and overlay.locate("aaa", "aa", occurrence=1) == (1, "occurrence")


def test_replay_changes_only_what_fits():
    assert overlay.replay(TEXT, [patch(1, "fox", "dog", TEXT, 20, 1)]) == ("the fox ran and the dog sat", [1], {})
    for p, why in [(patch(1, "fox", "x", TEXT, sha="0" * 64), "text changed"), (patch(1, "ran", " ", TEXT), "empty correction"), (patch(1, "cat", "x", TEXT), "not found"), (patch(1, "fox", "x", TEXT), "ambiguous")]:
        assert overlay.replay(TEXT, [p]) == (TEXT, [], {1: why})
    assert overlay.replay(TEXT, [patch(1, "ran", " ", TEXT, sha="0" * 64)])[2] == {1: "empty correction"}
    assert overlay.apply_all(TEXT, [patch(1, "ran", "hid", TEXT)]) == "the fox hid and the fox sat"
    with pytest.raises(ValueError, match="ambiguous"):
        overlay.apply_all(TEXT, [patch(1, "ran", "hid", TEXT), patch(2, "fox", "x", TEXT)])


def test_replay_holds_only_neighbours_against_each_other():
    text = "abcdefghijklmnop"
    long, middle, nested = patch(1, "abcdefghijkl", "L", text, 0), patch(2, "ij", "M", text, 8), patch(3, "cd", "N", text, 2)
    out, applied, stale = overlay.replay(text, [long, middle, nested])
    assert (out, applied, stale) == ("abcdefghMklmnop", [2], {1: "overlap", 3: "overlap"})


def test_replay_does_not_depend_on_the_order():
    patches = [patch(1, "fox", "dog", TEXT, 4), patch(2, "ran", "hid", TEXT), patch(3, "an", "x", TEXT, occurrence=1), patch(4, "sat", "lay down", TEXT), patch(5, "zzz", "y", TEXT)]
    assert len({str(overlay.replay(TEXT, list(p))) for p in itertools.permutations(patches)}) == 1


@settings(max_examples=60, deadline=None)
@given(st.text("ab ", max_size=20), st.lists(st.tuples(st.text("ab ", min_size=1, max_size=3), st.text("xyz", max_size=3), st.integers(-2, 22), st.integers(0, 4)), max_size=6))
def test_every_patch_is_applied_or_stale(text, raw):
    patches = [patch(i, s, c, text, o, n) for i, (s, c, o, n) in enumerate(raw)]
    _, applied, stale = overlay.replay(text, patches)
    assert sorted([*applied, *stale]) == list(range(len(raw)))


def edit(span, correction, text=TEXT, **more):
    return patch("new", span, correction, text, sha="") | more


def test_an_edit_is_planned_where_its_span_is():
    text = "the signal came from auto sebo in the jungle"
    plan, status = overlay.plan_edit(text, edit("auto sebo", "Arecibo"), [])
    assert status == "ok" and plan == (21, 30, 0, overlay.text_hash(text), "the signal came from Arecibo in the jungle", {})
    told = edit("fox", "dog", offset=3, occurrence=1)  # no fox at 3, so the second one
    assert overlay.plan_edit(TEXT, told, [])[0][:3] == (20, 23, 1)
    assert overlay.plan_edit("naïve 你好 fox", edit("fox", "dog"), [])[0][:2] == (9, 12)


@pytest.mark.parametrize(("new", "status"), [
    (edit("fox", "  "), "empty correction"), (edit("fox", None), "empty correction"), (edit("fox", "dog"), "ambiguous"), (edit("cat", "dog"), "not found"), (edit("", "dog"), "not found"),
    (edit("sat", "lay", sha256="another"), "text changed"), (edit("fox sat", "lay"), "overlap"), (edit("sat", "sat"), "ok"), (edit("ran", "hid"), "ok"),
])
def test_what_an_edit_must_clear(new, status):
    assert overlay.plan_edit(TEXT, new, [patch(1, "sat", "sits", TEXT)] if status == "overlap" else [])[1] == status


def test_an_edit_is_seen_beside_the_other_corrections():
    text = "a b c d"
    plan, status = overlay.plan_edit(text, edit("a", "X"), [patch(1, "d", "D!", text)])
    assert (status, plan.preview, plan.stale) == ("ok", "X b c D!", {})
    old, gone, apart = patch(1, "a b", "!", text, sha="old"), patch(2, "zz", "y", text), patch(3, "c", "C", text)
    plan, status = overlay.plan_edit(text, edit("a", "X"), [old, gone, apart])
    assert (status, plan.preview, plan.stale) == ("ok", "X b C d", {1: "text changed", 2: "not found"})  # what doesn't fit occupies nothing
    pair = [patch(1, "a b", "!", text), patch(2, "b c", "?", text)]
    assert overlay.plan_edit(text, edit("b", "B"), pair)[1] == "ok"  # both overlap each other, so neither is replayed


def word(w, s, e, speaker=None):
    return {"word": w, "start": s, "end": e, "speaker": speaker}


def test_segments_split_at_gaps_speakers_and_limits():
    assert [s["text"] for s in chunking.segments_of([word("a", 0, 1), word("b", 1.55, 2), word("c", 2.65, 3), word("d", 4.7, 5)])] == ["a b", "c", "d"]
    assert [s["text"] for s in chunking.segments_of([word("a", 0, 1, "x"), word("b", 1, 2, "y")])] == ["a", "b"]
    assert chunking.segments_of([]) == []
    many = [word(f"w{i}", i * 0.1, i * 0.1 + 0.1) for i in range(200)]
    assert [len(s["words"]) for s in chunking.segments_of(many)] == [80, 80, 40]
    long = [word(f"w{i}", float(i), i + 0.9) for i in range(70)]
    assert [(s["start"], s["end"]) for s in chunking.segments_of(long)] == [(0.0, 30.9), (31.0, 61.9), (62.0, 69.9)]
    unknown = [word("a", 0, 1, "x"), word("b", 1, 2), word("c", 2, 3, "y"), word("d", 3, 4, "x")]
    assert [s["text"] for s in chunking.segments_of(unknown)] == ["a b c", "d"]
    again = [w for s in chunking.segments_of(many) for w in s["words"]]
    assert chunking.segments_of(again) == chunking.segments_of(many)
    assert [w["word"] for w in chunking.clean_words([word("a", 0, 2), word("a", 1, 2), word("A", 1, 2), word("b", 2, 3), word("b", 3, 4)])] == ["a", "A", "b", "b"]


def test_entries_advance_and_dont_repeat_near_ones():
    at = lambda *x: [{"word": w, "start": s} for w, s in x]
    kept = lambda *x: [(r["word"], r["start"]) for r in chunking.advancing(at(*x))]
    assert kept(("very", 1.0), ("very", 1.3), ("good", 1.6)) == [("very", 1.0), ("very", 1.3), ("good", 1.6)]
    assert kept(("a", 1.0), ("b", 1.1), ("a", 1.2), ("c", 1.05), ("c", 1.1), ("a", 1.26)) == [("a", 1.0), ("b", 1.1), ("a", 1.26)]


def test_token_packing():
    words = str.split
    joined = lambda t: [" " + w for w in words(t)]
    assert chunking.pack_tokens("The quick brown fox jumps", 3, joined) == ["The quick brown", "fox jumps"]
    assert chunking.pack_tokens("", 3) == [""]
    segs = [{"text": t, "start": i, "end": i + 1, "speaker": s} for i, (t, s) in enumerate([("a b", "x"), ("c d", "y"), ("e", "y"), ("f g h i j", "x")])]
    assert [(c["text"], c["speaker"], c["start"], c["end"]) for c in chunking.pack_segments(segs, 4, words)] == [("a b c d", "y", 0, 2), ("e", "y", 2, 3), ("f g h i j", "x", 3, 4)]
    assert chunking.pack_segments([{"text": " lead", "start": 0, "end": 1, "speaker": None}, {"text": " x", "start": 1, "end": 2, "speaker": None}], 9)[0]["text"] == " lead  x"


def test_dominant_and_ids():
    assert chunking.dominant(["a", "b", "b", None]) == "b" and chunking.dominant(["a", "b"]) == "b" and chunking.dominant([None]) is None
    assert chunking.chunk_uuid("t", 1) == chunking.chunk_uuid("t", 1) != chunking.chunk_uuid("t", 2)


def test_state_machine():
    legal = "proposed>accepted proposed>rejected proposed>stale accepted>applied accepted>rejected accepted>stale applied>reverted applied>stale rejected>proposed reverted>proposed"
    states = ["proposed", "accepted", "applied", "rejected", "reverted", "stale", "nonsense"]
    assert {f"{a}>{b}" for a in states for b in states if findings.can_turn(a, b)} == set(legal.split())
    assert findings.sources_of("applied") == ["accepted"]
