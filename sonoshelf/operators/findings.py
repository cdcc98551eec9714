"""Findings of the judge and of people, and the corrections that they propose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoshelf.functions.text import book_dir

#: Buckets of the summary, and the floor below which findings aren't kept.
HIGH, MEDIUM, FLOOR, PER_CHUNK = 0.8, 0.4, 0.6, 5
# What a correction may become, by what it is, and the kinds of issues.
TRANSITIONS = {
    "proposed": {"accepted", "rejected", "stale"},
    "accepted": {"applied", "rejected", "stale"},
    "applied": {"reverted", "stale"},
    "rejected": {"proposed"},
    "reverted": {"proposed"},
    "stale": set(),
}
ISSUES = ("misheard_proper_noun", "misheard_word", "repeated_text", "number_artifact", "homophone", "dropped_word", "other")
#: Judges' answers of more bytes than this aren't parsed.
MOST_RESPONSE_BYTES = 10 << 20


def can_turn(a: str, b: str) -> bool:
    return b in TRANSITIONS.get(a, ())


def sources_of(state: str) -> list[str]:
    """The states from which a correction may become this."""
    return sorted(a for a, to in TRANSITIONS.items() if state in to)


def buckets(confidence: Column) -> list[Column]:
    return [F.count_if(confidence >= HIGH).alias("high"), F.count_if((confidence >= MEDIUM) & (confidence < HIGH)).alias("medium"), F.count_if(confidence < MEDIUM).alias("low")]


def totals(found: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return found.agg(F.count("*").alias("findings"), F.countDistinct("transcript_id").alias("transcripts"), F.round(F.avg(c), 6).alias("mean"), F.min(c).alias("lowest"), F.max(c).alias("highest"), *buckets(c))


def by_issue(found: DataFrame) -> DataFrame:
    return found.groupBy("issue_type").agg(F.count("*").alias("findings"), F.round(F.avg("confidence"), 6).alias("mean"))


def by_book(found: DataFrame, book: str) -> DataFrame:
    """Findings of each book with its most frequent issue, the smallest of equals. The counts are made first."""
    counts = found.groupBy(book, "issue_type").agg(F.count("*").alias("n"), F.max("confidence").alias("highest"))
    return counts.groupBy(book).agg(F.sum("n").alias("findings"), F.max("highest").alias("highest"), F.min_by("issue_type", F.struct((-F.col("n")).alias("n"), "issue_type")).alias("top_issue"))


def worklist(found: DataFrame, *, floor: float = 0.0, issue: str | None = None, scope: Column | None = None) -> DataFrame:
    """Identical corrections as one row: how many, the highest confidence and where, the surest and largest first."""
    rows = found.where(F.col("confidence") >= floor)
    rows = rows.where(F.col("issue_type") == issue) if issue else rows
    rows = rows.where(scope) if scope is not None else rows
    key = ["original_text", F.coalesce("suggested_correction", F.lit("")).alias("suggested_correction"), "issue_type"]
    return rows.groupBy(*key).agg(F.count("*").alias("findings"), F.max("confidence").alias("confidence"), F.min("id").alias("first_id")).orderBy(F.desc("confidence"), F.desc("findings"), "first_id")


def top_per_chunk(found: DataFrame, n: int = PER_CHUNK) -> DataFrame:
    """The n surest findings of each chunk; n of 0 or less keeps all."""
    if n <= 0:
        return found
    w = Window.partitionBy("transcript_id", "chunk_index").orderBy(F.desc("confidence"), "id")
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def with_chunk(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each finding with the text of its chunk, by chunk_id or, where that is null, by transcript and index. The two
    ways are two equality joins, which a condition with OR would make a loop over all pairs."""
    by_id = chunks.select(F.col("id").alias("_id"), F.col("text").alias("_text_by_id"))
    by_place = chunks.select(F.col("transcript_id").alias("_transcript"), F.col("chunk_index").alias("_index"), F.col("text").alias("_text_by_place"))
    out = found.join(by_id, F.col("chunk_id") == F.col("_id"), "left")
    out = out.join(by_place, F.col("chunk_id").isNull() & (F.col("transcript_id") == F.col("_transcript")) & (F.col("chunk_index") == F.col("_index")), "left")
    return out.withColumn("chunk_text", F.coalesce("_text_by_id", "_text_by_place")).drop("_id", "_text_by_id", "_transcript", "_index", "_text_by_place")


def parse_judgement(response: Column) -> Column:
    """The findings in a judge's answer: empty spans and changes that change nothing go, confidence is held to 0..1,
    unknown issues are other ones, negative anchors are unknown. Null if there is no object, or too long an answer."""
    from sonoshelf.functions.text import normalised, outer_json

    kind = "struct<findings:array<struct<original_text:string,issue_type:string,suggested_correction:string,confidence:double,anchor_offset:int,anchor_occurrence:int>>>"
    answer = F.from_json(F.when(F.octet_length(response) <= MOST_RESPONSE_BYTES, F.nullif(outer_json(response), F.lit(""))), kind)
    raw = F.when(answer.isNotNull(), F.coalesce(answer["findings"], F.array()))
    text = lambda f, name: F.trim(F.coalesce(f[name], F.lit("")))
    fine = F.filter(raw, lambda f: (text(f, "original_text") != "") & (text(f, "suggested_correction") != "") & (normalised(f["original_text"]) != normalised(f["suggested_correction"])))
    issue = lambda f: F.lower(text(f, "issue_type"))
    return F.transform(fine, lambda f: F.struct(
        text(f, "original_text").alias("original_text"), F.when(issue(f).isin(*ISSUES), issue(f)).otherwise("other").alias("issue_type"), text(f, "suggested_correction").alias("suggested_correction"),
        F.least(F.greatest(F.coalesce(f["confidence"], F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        *[F.when(f[c] >= 0, f[c]).alias(c) for c in ("anchor_offset", "anchor_occurrence")],
    ))


def decide(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """found after decisions (id, expected, state, at): only where the state is the expected one and may turn to the new.
    Of several that expect the same of a finding, the first counts, as the others don't find that state any more."""
    legal = found.sparkSession.createDataFrame([(a, b) for a, to in sorted(TRANSITIONS.items()) for b in sorted(to)], "_from string, _to string")  # nine rows
    first = decisions.join(F.broadcast(legal), (F.col("expected") == F.col("_from")) & (F.col("state") == F.col("_to"))).groupBy("id", "expected").agg(F.min(F.struct("at", "state")).alias("first"))
    d = first.select(F.col("id").alias("_of"), "expected", F.col("first.state").alias("_to"))
    out = found.join(d, (F.col("id") == F.col("_of")) & (F.col("patch_state") == F.col("expected")), "left")
    changed = F.col("_to").isNotNull()
    return out.withColumn("patch_state", F.when(changed, F.col("_to")).otherwise(F.col("patch_state"))).withColumn("changed", changed).drop("_of", "expected", "_to")


def clear_stale(chunks: DataFrame, found: DataFrame, watermark: Column) -> DataFrame:
    """chunks with embedding_stale cleared, except where a finding was decided after the watermark or waits to be
    applied."""
    blocks = found.where((F.col("decided_at") > watermark) | (F.col("patch_state") == "accepted")).select("transcript_id", "chunk_index").distinct().withColumn("_held", F.lit(True))
    out = chunks.join(blocks, ["transcript_id", "chunk_index"], "left")
    return out.withColumn("embedding_stale", F.col("embedding_stale") & F.col("_held").isNotNull()).select(chunks.columns)


def insert(found: DataFrame, new: DataFrame) -> DataFrame:
    """found with new findings, which begin as proposed; columns that new lacks are null."""
    fresh = new.select("*", F.lit("proposed").alias("patch_state")) if "patch_state" not in new.columns else new
    return found.unionByName(fresh, allowMissingColumns=True)


def clear(found: DataFrame, scope: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(what is left of found, the number of findings that go): those in the scope, or all."""
    gone = F.coalesce(scope, F.lit(False)) if scope is not None else F.lit(True)
    return found.where(~gone), found.agg(F.count_if(gone).alias("removed"))


def overlay_of(found: DataFrame, transcripts: Column | None = None) -> DataFrame:
    """The corrections to be replayed, accepted or applied before, by chunk and place; those without a place last."""
    rows = found.where(F.col("patch_state").isin("accepted", "applied"))
    rows = rows.where(transcripts) if transcripts is not None else rows
    return rows.orderBy("transcript_id", "chunk_index", F.asc_nulls_last("anchor_offset"), "id")


def mark_outcomes(found: DataFrame, outcomes: DataFrame) -> DataFrame:
    """found after a replay's outcomes (id, state, reason): applied or stale where the state may turn so; what was
    applied before and is again stays."""
    legal = F.lit(False)
    for state in ("applied", "stale"):
        legal = legal | ((F.col("_state") == state) & F.col("patch_state").isin(sources_of(state)))
    told = outcomes.groupBy(F.col("id").alias("_of")).agg(F.max(F.struct("state", "reason")).alias("_told"))
    out = found.join(told, F.col("id") == F.col("_of"), "left").withColumn("_state", F.col("_told.state")).withColumn("_legal", F.coalesce(legal, F.lit(False)))
    out = out.withColumn("stale_reason", F.when(F.col("_legal") & (F.col("_state") == "stale"), F.col("_told.reason")))
    return out.withColumn("patch_state", F.when(F.col("_legal"), F.col("_state")).otherwise(F.col("patch_state"))).drop("_of", "_told", "_state", "_legal")


def mark_applied(found: DataFrame, applied: DataFrame, as_of: Column) -> DataFrame:
    """found after corrections were applied (id, before, after: the span's text then and now): in the state applied, with
    both texts and the time, where the state may turn so or is so already; a repeat of an id gives the greatest texts."""
    told = applied.groupBy(F.col("id").alias("_of")).agg(F.max(F.struct("before", "after")).alias("_told"))
    out = found.join(told, F.col("id") == F.col("_of"), "left")
    legal = F.col("_told").isNotNull() & F.col("patch_state").isin([*sources_of("applied"), "applied"])
    old = lambda c, kind: F.col(c) if c in found.columns else F.lit(None).cast(kind)
    values = {"patch_state": (F.lit("applied"), "string"), "applied_at": (as_of, "timestamp"), "applied_before_text": (F.col("_told.before"), "string"), "applied_after_text": (F.col("_told.after"), "string")}
    changed = {c: F.when(legal, v).otherwise(old(c, kind)) for c, (v, kind) in values.items()}
    return out.withColumns(changed).drop("_of", "_told")


def listed(found: DataFrame, jobs: DataFrame, directory: str | None = None, limit: int | None = None) -> DataFrame:
    """The surest findings (file_path, confidence, start_sec, and others), of one book or of all, with their job and book:
    at most limit, 200 by default. They are cut before jobs are joined; a book's prefix reaches the reader."""
    rows = found if directory is None else found.where(F.col("file_path").startswith(directory.rstrip("/") + "/"))
    first = [F.desc("confidence"), F.col("file_path"), F.col("start_sec"), F.col("id")]
    top = rows.orderBy(*first).limit(limit if limit and limit > 0 else 200)
    of = jobs.select(F.col("id").alias("job_id"), F.col("file_path").alias("_path"))
    return top.join(of, F.col("file_path") == F.col("_path"), "left").withColumn("book_dir", book_dir(F.col("file_path"))).drop("_path").orderBy(*first)


def flagged(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """chunks with embedding_stale set where a finding of theirs has changed (transcript_id, chunk_index)."""
    changed = found.select("transcript_id", "chunk_index").distinct().withColumn("_hit", F.lit(True))
    out = chunks.join(changed, ["transcript_id", "chunk_index"], "left")
    return out.withColumn("embedding_stale", F.coalesce(F.col("embedding_stale"), F.lit(False)) | F.col("_hit").isNotNull()).select(chunks.columns)


def groups(found: DataFrame, most: int = 50) -> DataFrame:
    """Identical corrections as one row with the first places where they stand, the surest first, at most so many."""
    key = ["original_text", F.coalesce("suggested_correction", F.lit("")).alias("suggested_correction"), "issue_type"]
    place = Window.partitionBy("original_text", F.coalesce("suggested_correction", F.lit("")), "issue_type").orderBy(F.desc("confidence"), "id")
    at = F.struct(F.col("_n").alias("n"), "transcript_id", "chunk_index", "start_sec")
    rows = found.withColumn("_n", F.row_number().over(place))
    by = rows.groupBy(*key).agg(F.count("*").alias("findings"), F.max("confidence").alias("confidence"), F.sort_array(F.collect_list(F.when(F.col("_n") <= most, at))).alias("places"))
    return by.withColumn("places", F.transform("places", lambda x: x.dropFields("n")))
