"""The registered queries on the smallest tables, against SQL or brute force, and the pipeline against plain Python."""

import hashlib
import math
import zlib
from array import array
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from compare import TABLES, rows_of
from sonoshelf.llm import byte_bpe, entry, mixing, ngram_lm, quality

from . import test_jaccard_join, test_ngram_lm, test_pii

SF = "/root/testdata/sf0.001"
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})


@pytest.fixture(scope="module")
def docs():
    return list(pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text", "source"]].itertuples(index=False, name=None))


def rows(spark, name):
    return {r.doc_id: r for r in entry.QUERIES[name](spark, SF).collect()}


@pytest.mark.parametrize("name", sorted(entry.ORACLE_SQL))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.QUERIES[name](spark, SF)
    cur = con.execute(entry.ORACLE_SQL[name])
    columns = [x[0] for x in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


def test_op2(spark, docs):
    got = rows(spark, "op2_quality")
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    assert got.keys() == {i for i, *_ in docs}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(got[i].predicted, q) for i, q in zip(labels.doc_id, labels.quality, strict=True) if i in got and got[i].held_out]
    assert sum(p == q for p, q in held) >= 0.9 * len(held)


def test_op4(spark, docs):
    want = test_ngram_lm.brute([(i, t) for i, t, _ in docs])
    for i, r in rows(spark, "op4_ngram_lm").items():
        held, n, known, train, base, score = want[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and abs(r.score - score) <= n * ngram_lm.CODE_STEP / 2 + 1e-6


def test_op5(spark, docs):
    t, got, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), rows(spark, "op5_token_files"), 0
    for i, text, _ in sorted(docs):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(array("I", ids).tobytes()))
        start += len(ids)


def test_op8(spark, docs):
    got = rows(spark, "op8_pii")
    for i, text, _ in docs:
        spans = test_pii.brute(text)
        n = Counter(x[2] for x in spans)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (n["email"], n["ip"], n["card"], n["phone"])
        told = [f"{k}:{s}:{e}" for s, _, k, e in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert set(told) <= set(r.spans.split(",")) if told else True


def test_op9(spark, docs):
    got = rows(spark, "op9_byte_bpe")
    for i, text, _ in docs:
        ids = TIKTOKEN.encode_ordinary(text or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_op10(spark, docs):
    got = sorted((r.doc_id, r.class_id, r.n_links, r.group_id) for r in entry.QUERIES["op10_jaccard_join"](spark, SF).collect())
    assert got == test_jaccard_join.brute([(i, t) for i, t, _ in docs])


def mixed(kept):
    """Copies of (doc_id, text, source), by sorting on the hash."""
    size = {d[0]: len((d[1] or "").split()) for d in kept}
    by = defaultdict(list)
    for d in kept:
        by[d[2]].append(d)
    sums = {s: sum(size[d[0]] for d in x) for s, x in by.items()}
    order = sorted(by)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    full, target, total = set(), {}, sum(sums.values())
    while True:
        left, w = total - sum(3 * sums[s] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: 3 * sums[s] if s in full else left * weight[s] / w for s in order}
        if not (over := {s for s in order if s not in full and target[s] > 3 * sums[s]}):
            break
        full |= over
    out = []
    for s, x in by.items():
        whole = int(target[s] // sums[s]) if sums[s] else 0
        rest, upto = target[s] - whole * sums[s], 0
        for d in sorted(x, key=lambda d: hashlib.md5(str(d[0]).encode()).hexdigest()[:15]):
            n = size[d[0]]
            more = rest > 0 and (upto + n < rest or (upto < rest and upto + n - rest < rest - upto))
            upto += n
            out += [d] * (whole + more)
    return out


def test_pipeline(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    table = spark.read.parquet(f"{SF}/documents.parquet")
    w = quality.fit(table, spark.read.parquet(f"{SF}/labels.parquet"))
    good = [d for d, s in zip(docs, quality.score([d[1] or "" for d in docs], w.astype("float32").astype(float)), strict=True) if s >= quality.THRESHOLD]
    best = {}
    for d in good:
        best[d[1] or ""] = max(best.get(d[1] or "", d), d)
    single = sorted(best.values())
    groups = {i: g for i, _, _, g in test_jaccard_join.brute([(i, t) for i, t, _ in single])}
    kept = [d for d in single if groups[d[0]] == d[0]]
    want = sorted((i, len(ids := TIKTOKEN.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) for i, t, _ in mixed(kept))
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want
    one = corpus_pipeline.STAGES[0][1](spark, table, SF)
    assert one.schema == table.schema
    assert mixing.take(one).columns == table.columns
