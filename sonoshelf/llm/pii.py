"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Nearby words are those from 40 characters before a match to 40 after it, the match and other matches among them.

All of it is Column functions. A kind's matches and the text between them come from one pattern, so the positions
are running sums of lengths in code points. The patterns are possessive and start only where no earlier start could
match, which finds the same leftmost matches without going over a long run of digits or letters again and again.

Kinds: email; ip (parts at most 255); card (12 to 19 digits, Luhn); phone (9 to 15 digits); and, as additions, iban
(15 to 34 letters and digits, remainder 1 modulo 97) and secret (a value of 16 or more characters, letters and digits
both, that a text gives to a key, password or token). A match that fails its check is dropped, and so is one of an added
kind whose score is below ``ADDED_THRESHOLD``; base kinds stay whatever their score, which comes with them.

Defined results: a null text counts as empty; a text without personal data has no spans; overlapping spans of
different kinds all stay; extra columns are ignored; rows are independent, so repeated rows repeat their result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# What each kind looks like, with \G for starts right after the match before.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
SECRET = r"(?i)(?<![a-z0-9])(?:api[_-]?key|access[_-]?key|auth|bearer|credential|passwd|password|secret|token)s?[\x20_]{0,2}[=:][\x20]{0,2}[\x22']?[a-z0-9+/_-]{16,}"
#: Kind: pattern, a text that has none of this can't match, words that raise the score, words that lower it.
KINDS = {
    "email": (EMAIL, "@", "mail email e-mail contact write address reach send reply correo courriel", "example noreply sample test dummy"),
    "ip": (IP, None, "ip host server address login client gateway network subnet dns", "version release chapter section build revision"),
    "card": (CARD, None, "card visa mastercard amex credit debit payment pay paid cvv expires", "order isbn number part invoice tracking serial"),
    "phone": (PHONE, "+", "phone call tel telephone mobile cell fax sms whatsapp dial", "version sum score ratio order"),
    "iban": (IBAN, None, "iban bank account transfer bic swift konto compte cuenta", "serial part code model sku"),
    "secret": (SECRET, None, "key token password passwd secret credential bearer auth login", "example sample dummy placeholder changeme checksum"),
}
#: What a text must hold for a match of the kind, where that isn't a digit.
MAY = {"iban": "[A-Z]{2}[0-9]{2}", "secret": r"[=:][\x20]{0,2}[\x22']?[A-Za-z0-9+/_-]{16}"}
BASE_KINDS = ("email", "ip", "card", "phone")
BASE_SCORE, CONTEXT, CONTEXT_STEP = 0.6, 40, 0.2
#: What a match of an added kind must score: without any context it stays, with only a lowering word it goes.
ADDED_THRESHOLD = 0.6
#: Texts are cut to pieces of so many code points, so that what is near a match is found without reading up to there.
PIECE = 1000
#: Positions are summed in runs of so many matches.
RUN = 200


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of up to 19 digits passes Luhn."""
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """The remainder of an account number modulo 97, first four characters last, letters as 10 to 35."""
    moved = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: (F.when(value(c) > 9, a * 100).otherwise(a * 10) + value(c)) % 97)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        return F.length(_digits(m)).between(12, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        joined = F.regexp_replace(m, " ", "")
        return F.length(joined).between(15, 34) & (mod97(joined) == 1)
    if kind == "secret":
        value = F.regexp_extract(m, "[A-Za-z0-9+/_-]+$", 0)
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.lit(True)


def _around(start: Column, end: Column) -> Column:
    """The text from CONTEXT characters before start to as many after end."""
    first, last = F.greatest(start - CONTEXT, F.lit(0)), end + CONTEXT
    piece = F.floor(first / PIECE).cast("int")
    pieces = F.array_join(F.slice("_pieces", piece + 1, F.floor(last / PIECE).cast("int") - piece + 1), "")
    return F.substring(pieces, first - piece * PIECE + 1, last - first)


def _near(around: Column, words: str) -> Column:
    """Whether one of the words stands in the text around a match."""
    return F.lower(around).rlike("(?:^|[^a-z])(?:" + words.replace(" ", "|") + ")(?:$|[^a-z])")


def _runs(lengths: Column) -> Column:
    """Running sums of lengths that start anew after each RUN of them, as an array of arrays: an array that grows is
    copied at each step, so it must not grow with the text."""
    sums = lambda run: F.aggregate(run, F.array().cast("array<int>"), lambda a, x: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x))
    starts = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / RUN).cast("int"))
    return F.when(F.size(lengths) > 0, F.transform(starts, lambda i: sums(F.slice(lengths, i * RUN + 1, F.lit(RUN)))))


def _joined(runs: Column) -> Column:
    """The running sums of all runs in one array."""
    before = F.aggregate(runs, F.array(F.lit(0)), lambda a, run: F.array_append(a, F.element_at(a, -1) + F.element_at(run, -1)))
    return F.flatten(F.zip_with(runs, F.slice(before, 1, F.size(runs)), lambda run, b: F.transform(run, lambda x: x + b)))


def _checked(kind: str, rank: int, up: str, down: str) -> Column:
    """The matches of a kind that pass its check, with positions and scores."""
    ends = F.col(f"_at_{kind}")

    def span(m: Column, i: Column) -> Column:
        return F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.get(ends, i).alias("end"), m.alias("value"))

    def scored(x: Column) -> Column:
        around = _around(x["start"], x["end"])
        score = F.lit(BASE_SCORE) + F.when(_near(around, up), 2 * CONTEXT_STEP).otherwise(0.0) - F.when(_near(around, down), CONTEXT_STEP).otherwise(0.0)
        return F.struct(*[x[c].alias(c) for c in ("start", "rank", "kind", "end", "value")], score.alias("score"))

    found = F.transform(F.filter(F.transform(F.col(f"_{kind}"), span), lambda x: _valid(kind, x["value"])), scored)
    return found if kind in BASE_KINDS else F.filter(found, lambda x: x["score"] >= ADDED_THRESHOLD)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, findings): findings is an array of (start, rank, kind, end, value, score) in text order, by start and
    then kind; score is from 0 to 1."""
    text = text_or_empty(text_col)
    step = docs.select(id_col, text.alias("_text"))
    for kind, (pattern, needs, _, _) in KINDS.items():
        none = F.array().cast("array<string>")
        may = F.contains(F.col("_text"), F.lit(needs)) if needs else F.col("_text").rlike(MAY.get(kind, "[0-9]"))
        step = step.withColumn(f"_{kind}", F.when(may, F.regexp_extract_all("_text", F.lit(pattern), 0)).otherwise(none))
    for kind, (pattern, *_) in KINDS.items():
        # of each match, the length of the text since the match before and its own
        found, gaps = F.col(f"_{kind}"), F.split("_text", pattern, -1)
        lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
        step = step.withColumn(f"_lengths_{kind}", F.when(F.size(found) > 0, lengths))
    step = step.withColumns({f"_runs_{kind}": _runs(F.col(f"_lengths_{kind}")) for kind in KINDS})
    some = F.greatest(*[F.size(f"_{kind}") for kind in KINDS]) > 0
    ends = [_joined(F.col(f"_runs_{kind}")).alias(f"_at_{kind}") for kind in KINDS]
    step = step.select("_text", id_col, *[f"_{kind}" for kind in KINDS], *ends, F.when(some, F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{PIECE}}}"), 0)).alias("_pieces"))
    found = []
    for rank, (kind, (_, _, up, down)) in enumerate(KINDS.items()):
        none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,value:string,score:double>>")
        found.append(F.when(F.size(f"_{kind}") > 0, _checked(kind, rank, up, down)).otherwise(none))
    return step.select(id_col, F.array_sort(F.concat(*found)).alias("findings"))


def written(findings: Column) -> Column:
    """kind:start:end of the findings, joined by commas."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds and of all spans, the SHA-256 of the base spans, all spans as text and their scores."""
    of = lambda *kinds: F.filter("findings", lambda x: x["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    scores = F.array_join(F.transform("findings", lambda x: F.round(x["score"], 1).cast("string")), ",")
    return found.select(
        id_col, *counts, F.size("findings").cast("long").alias("n_spans"), F.sha2(written(of(*BASE_KINDS)).cast("binary"), 256).alias("base_sha256"),
        written(F.col("findings")).alias("spans"), scores.alias("scores"),
    )
