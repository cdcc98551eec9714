import hashlib
import re
import time

import pytest

from sonoshelf.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(text):
    out = []
    for rank, (kind, p) in enumerate(BASE.items()):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(p, text or "") if valid(kind, m[0])]
    return sorted(out)


CASES = [
    None,
    "",
    "plain text",
    "mail a@b.co_x@y.zz and q.r+s@t-u.example.com.",
    "é世 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111",
    "+1 (244) 555-4688 and +12 3 ++1 234 567 890 1",
    "a@b" + ".c" * 3000,
    "9" * 5000 + " " + "1." * 3000 + "x" * 5000 + "@",
    "IBAN GB82 WEST 1234 5698 7654 32 or DE89370400440532013000, GB82WEST12345698765433",
    "x@y.z," * 300,
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(CASES)], "doc_id long, text string, findings string")
    return {r.doc_id: r for r in pii.find(docs).collect()}, {r.doc_id: r for r in pii.digest(pii.find(docs)).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_base_spans_are_those_of_brute_force(found, i):
    want = brute(CASES[i])
    got = [(x.start, x.rank, x.kind, x.end) for x in found[0][i].findings if x.kind in BASE]
    assert got == want
    joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want)
    assert found[1][i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
    assert found[1][i].n_email == sum(x[2] == "email" for x in want)


def test_account_numbers_need_their_checksum(found):
    assert [x.value for x in found[0][9].findings if x.kind == "iban"] == ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"]


def test_added_kinds_need_a_score_and_base_kinds_dont(spark):
    texts = [
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "API_KEY: abcdef0123456789ABCDEF.", "token = abcdefghijklmnopqrstuvwxyz", "token = 0123456789012345678",
        "serial GB82 WEST 1234 5698 7654 32", "bank serial GB82 WEST 1234 5698 7654 32", "version 1.2.3.4", "tokenizer = a1b2c3d4e5f6a7b8c9d0",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.spans, r.scores, r.n_spans) for r in pii.digest(pii.find(docs)).collect()}
    assert got[0] == ("secret:0:49", "1.0", 1) and got[1][0] == "secret:0:31"
    assert got[2] == got[3] == got[4] == got[7] == ("", "", 0)
    assert got[5] == ("iban:12:39", "0.8", 1)
    assert got[6] == ("ip:8:15", "0.4", 1)


def test_context_moves_the_score(spark):
    docs = spark.createDataFrame([(1, "call +1 234 567 8901"), (2, "xx +1 234 567 8901"), (3, "sum +1 234 567 8901")], "doc_id long, text string")
    s = {r.doc_id: r.findings[0].score for r in pii.find(docs).collect()}
    assert s[1] > s[2] > s[3]


def test_context_is_what_stands_around_a_match(spark, monkeypatch):
    monkeypatch.setattr(pii, "PIECE", 50, raising=False)
    texts = [
        "call +1 234 567 8901, +1 234 567 8902", "+1 234 567 8901 is my phone", "call " + "x" * 36 + "+1 234 567 8901", "é世𝄞\n" * 40 + "tel +1 234 567 8901 " + "y " * 60 + "call",
        "+1 234 567 8901" + "," * 38 + " mobile", "x@y.z\n" * 40 + "noreply", "+12345678901" + " " * 60 + "call",
    ]
    for i, r in enumerate(pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()):
        assert r.findings
        for x in r.findings:
            around = texts[i][max(0, x.start - 40) : x.end + 40].lower()
            up, down = (bool(re.search("(?:^|[^a-z])(?:" + w.replace(" ", "|") + ")(?:$|[^a-z])", around)) for w in pii.KINDS[x.kind][2:])
            assert x.score == pytest.approx(0.6 + 0.4 * up - 0.2 * down), (texts[i], x)
        if i < 2:
            assert all(x.score > 0.9 for x in r.findings)


@pytest.mark.parametrize("n", [1, 199, 200, 201, 400, 1001])
def test_positions_hold_across_runs(spark, n):
    text = "".join(f"é{'z' * (i % 7)} m{i}@b.co 10.0.{i % 300}.1 " for i in range(n))
    (row,) = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(x.start, x.rank, x.kind, x.end) for x in row.findings] == brute(text)
    assert all(text[x.start : x.end] == x.value for x in row.findings)


def test_time_grows_with_the_matches_and_not_their_square(spark, tmp_path):
    took = {}
    for n in (1000, 20_000, 80_000):  # the first warms up
        at = str(tmp_path / str(n))
        spark.createDataFrame([(1, "".join(f"a{i}@b.co, " for i in range(n)))], "doc_id long, text string").write.parquet(at)
        began = time.monotonic()
        assert [r.n_email for r in pii.digest(pii.find(spark.read.parquet(at))).collect()] == [n]
        took[n] = time.monotonic() - began
    assert took[80_000] < 7 * took[20_000]


def test_empty_table(spark):
    assert pii.digest(pii.find(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
