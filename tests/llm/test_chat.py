"""Chat formatting against plain Python, and its edges."""

import hashlib
import random
from collections import defaultdict

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sonoshelf.llm import chat

PATH = P.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<", "\n\nend ", " lead", "naïve 你好 🤦🏼‍♂️", "<|endoftext|>", "", None, "<|im_sep|>" * 3, "a  b\t\n c", "\x1c\x1f x"]


@pytest.fixture(scope="module")
def encoder():
    return chat.Encoder(PATH)


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        by[conv].append(((turn is not None, turn or 0), role, hashlib.sha256(text.encode()).hexdigest(), text))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(t for _, r, _, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, _, t in turns)
        formatted = "".join(f"{chat.START}{chat.escape(r)}{chat.SEP}{chat.escape(t)}{chat.END}" for _, r, _, t in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha(whole), len(said), sha(said), len(formatted))
    return out


@given(st.text(st.sampled_from("<|\\>ab_imstrtend "), max_size=60))
def test_escapes_are_reversible_and_leave_no_mark(text):
    told = chat.escape(text)
    assert chat.unescape(told) == text and "<|" not in told


@settings(deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a<|b"]), st.one_of(st.sampled_from([x or "" for x in ODD]), st.text(max_size=30))), max_size=6))
def test_tokens_turns_and_masks(encoder, turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    ((ids, starts, ends),) = encoder.encode([text])
    assert encoder.tokenizer.decode(ids.tolist(), skip_special_tokens=False) == text
    mask = chat.loss_mask(starts, ends, spans)
    assert chat.masked_text(text, starts, ends, mask) == "".join(t for r, t in turns if r == "assistant")
    # by comparing each token with each span
    assert mask.tolist() == [any(s < b and e > a for a, b in spans) for s, e in zip(starts, ends)]


def test_ids_and_offsets_are_those_of_the_library(encoder):
    r = random.Random(5)
    words = ["word", "wörd's", "12", "_x", "  ", "\n", "..", "<|im_end|>", "你好", "🤦🏼‍♂️", "\x1c", "e\u0301", "<|endoftext|>", "ﬃ", "don't"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(300))) for _ in range(40)] + [""] + ["".join(r.choice(words) for _ in range(50)) for _ in range(40)]
    for got, text in zip(encoder.encode(texts), texts, strict=True):
        want = encoder.tokenizer.encode(text, add_special_tokens=False)
        assert got[0].tolist() == want.ids and list(zip(got[1].tolist(), got[2].tolist(), strict=True)) == want.offsets


def test_parse_refuses_what_was_not_rendered():
    with pytest.raises(ValueError):
        chat.parse(f"x{chat.START}user{chat.SEP}a{chat.END}")


@pytest.mark.parametrize("turns", [2, 256])
def test_conversations_are_those_of_brute_force(spark, turns):
    r = random.Random(turns)
    rows = [(r.choice([0, 0, 0, 1, 2, None]), r.choice([None, *range(40)]), r.choice(["user", "assistant", "system", None]), r.choice(ODD)) for _ in range(120)]
    rows += [(7, 1, "assistant", "same"), (7, 1, "assistant", "same"), (8, 0, "user", "x " * 30_000 + "<|"), (9, 0, None, None)]
    df = spark.createDataFrame([(*x, "extra", 1) for x in rows], SCHEMA + ", part string, ids int").repartition(5)
    got = {x.conv_id: tuple(x)[1:] for x in chat.digests(chat.format_conversations(df, PATH, turns=turns)).collect()}
    assert got == brute(rows)


def test_parts_hold_at_most_so_many_turns(spark):
    df = spark.createDataFrame([(i % 2 * i, i, "user", str(i)) for i in range(100)], SCHEMA)
    parts = chat.in_parts(df, 8).collect()
    assert max(len(p.turns) for p in parts) == 8
    assert [t.text for p in sorted(parts, key=lambda p: p.part) if p.conv_id == 0 for t in p.turns] == [str(i) for i in range(0, 100, 2)]


def test_an_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chat.digests(chat.format_conversations(df, PATH)).collect() == []
