import hashlib
import random
import zlib
from array import array
from pathlib import Path
from urllib.parse import urlparse

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sonoshelf.llm import byte_bpe, entry, token_files
from sonoshelf.llm.common import new_path

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "Plain words, here.", "  two  spaces ", "a\n b\n\n c \t d", "it's 'll 're x'sll 12 345!!", "é世界 x y Straße ÉCOLE ÅΣΑΣ İ ﬁ",
    "abc" * 700, "<|endoftext|> z", " ac ro\x1css\x85 end", "Same text", "Same text", "é ́x µ ²½",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(50 - i, t, 0, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int, ids string")


def test_byte_bpe_is_that_of_the_library(docs):
    ranks = byte_bpe.read_ranks(RANKS)
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.round_trip(docs, RANKS, P.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        ids = e.encode_ordinary(t or "")
        r = got[50 - i]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_encode_then_decode_gives_the_text(docs):
    raw = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN), RANKS)
    assert {r.doc_id: bytes(r.raw).decode() for r in raw.collect()} == {50 - i: t or "" for i, t in enumerate(TEXTS)}


def test_long_pieces_take_the_heap_and_agree_with_recursion():
    coder = byte_bpe.PieceCoder(RANKS)
    pieces = [b"abracadabra" * 9, b" thonreoution", b"\xff\xfe\x00", b"zzzzzzzz"]
    want = [byte_bpe.heap_merge(p, coder.ranks) for p in pieces]
    assert coder.encode(pieces).to_pylist() == want
    assert coder.decode(coder.encode(pieces)).to_pylist() == pieces
    assert coder.encode([b"abcabd" * 90]).to_pylist() == [byte_bpe.heap_merge(b"abcabd" * 90, coder.ranks)]


def random_texts(alphabet, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_chunks_of_random_texts_are_encoded_as_by_the_library():
    texts = random_texts("   \n\tab'sé世1.,\x1c\x85T", 5000, 3)
    coder = byte_bpe.TextCoder(RANKS, P.PATTERN)
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.coder.ranks, special_tokens={})
    for part in (texts[:1000], texts[1000:], texts):  # with nothing, something and all known
        ids = coder.encode(pa.array(part))
        assert ids.to_pylist() == [e.encode_ordinary(t) for t in part]
        assert coder.coder.decode(ids).to_pylist() == [t.encode() for t in part]


def test_random_texts_have_the_ids_of_the_file_as_loaded():
    texts = random_texts(["  ", " ", "\n", "ab", "'s", "é", "É", "Σ", "İ", "世", "1", ".", "\x1c", "\x85", "<|endoftext|>", "<|", "|>", "<|EndOfText|>", "\u0301"], 5000, 4)
    encoder, t = token_files.ChunkEncoder(WORDS), Tokenizer.from_file(WORDS)
    for part in (texts[:1000], texts[1000:], texts):
        assert encoder.encode(pa.array(part)).to_pylist() == [t.encode(x, add_special_tokens=False).ids + [1] for x in part]


def test_files_are_put_in_order_by_number(spark):
    at = new_path(spark, "tokens")
    rows = spark.createDataFrame([(1, 0, 2, [5, 1])], token_files.FILE_SCHEMA)
    for n in (99_999, 100_000):
        rows.withColumn("doc_id", F.lit(n).cast("long")).coalesce(1).write.orc(f"{at}-{n}")
    folder = Path(urlparse(at).path)
    folder.mkdir()
    for n in (99_999, 100_000):
        (found,) = Path(f"{folder}-{n}").glob("part-*.orc")
        found.rename(folder / f"part-{n:05d}-x.orc")
    assert sorted((r.doc_id, r.start) for r in token_files.read_tokens(spark, at).collect()) == [(99_999, 0), (100_000, 2)]


def test_token_files_hold_the_ids_in_order_of_id(spark, docs):
    t = Tokenizer.from_file(WORDS)
    at = new_path(spark, "tokens")
    token_files.write_tokens(docs, at, WORDS, files=3)
    got = {r.doc_id: r for r in token_files.with_checksum(token_files.read_tokens(spark, at)).collect()}
    start = 0
    for doc_id, text in sorted((50 - i, t or "") for i, t in enumerate(TEXTS)):
        ids = t.encode(text, add_special_tokens=False).ids + [1]
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (start, len(ids), zlib.crc32(array("I", ids).tobytes())), text
        start += len(ids)


def test_op5_has_the_ids_of_the_file_as_loaded(spark, tmp_path):
    texts = TEXTS + [
        "a <|endoftext|> z", "x<|startoftext|>y", "<|endoftext|><|endoftext|>'s <|ENDOFTEXT|> <|ENDOFTEXT|>'s", "<|EndOfText|>é世", "é<|endoftext|>\u0301 <|endoftext",
        "<|<|endoftext|>|> \x1c<|endoftext|>\x1f", "<|endoftext|>", "ΑΣ<|endoftext|>ΑΣ it'<|startoftext|>ll",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    t, got, start = Tokenizer.from_file(WORDS), {r.doc_id: r for r in entry.op5_token_files(spark, str(tmp_path)).collect()}, 0
    assert t.encode(texts[len(TEXTS)], add_special_tokens=False).ids == [320, 49407, 345]
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(array("I", ids).tobytes())), text
        start += len(ids)


def test_starts_hold_where_the_session_limits_records_of_a_file(spark, docs):
    at = [new_path(spark, "tokens") for _ in range(2)]
    token_files.write_tokens(docs, at[0], WORDS, files=2)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 7)
    try:
        token_files.write_tokens(docs, at[1], WORDS, files=2)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    plain, limited = [sorted((r.doc_id, r.start) for r in token_files.read_tokens(spark, x).collect()) for x in at]
    assert plain == limited


def test_a_filter_on_the_id_reaches_the_orc_reader(spark, docs):
    at = new_path(spark, "tokens")
    token_files.write_tokens(docs, at, WORDS, files=2)
    one = token_files.read_tokens(spark, at).where(F.col("doc_id") == 47)
    assert "EqualTo(doc_id,47)" in one._jdf.queryExecution().toString()
    assert one.count() == 1


def test_empty_tables_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    at = new_path(spark, "tokens")
    token_files.write_tokens(empty, at, WORDS, files=2)
    assert token_files.with_checksum(token_files.read_tokens(spark, at)).collect() == []
    assert byte_bpe.round_trip(empty, RANKS, P.PATTERN).collect() == []
    nulls = spark.createDataFrame([(None, "b a"), (3, "c"), (3, "c")], "doc_id long, text string")
    at = new_path(spark, "tokens")
    token_files.write_tokens(nulls, at, WORDS, files=2)
    assert sorted((r.start, r.doc_id) for r in token_files.read_tokens(spark, at).collect()) == [(0, None), (3, 3), (5, 3)]
