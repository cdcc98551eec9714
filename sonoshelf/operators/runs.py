"""Measures of a run, and the slices that each stage writes of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a recogniser may be able to do.
CAPABILITIES = ("word_timestamps", "context_biasing", "diarization", "confidence_scores", "language_detection")
FLAGS, REASONS = "map<string,boolean>", "map<string,string>"


def mean_word_confidence(segments: Column) -> Column:
    """The mean score of the words of segments, of those that have one; null if none has."""
    scores = F.filter(F.flatten(F.transform(segments, lambda s: F.transform(F.coalesce(s["words"], F.array()), lambda w: w["score"].cast("double")))), lambda x: x.isNotNull())
    return F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores))


def run_statistics(segments: Column) -> list[Column]:
    """raw_text, word_count, char_count and segment_count of a transcript's segments."""
    raw = F.array_join(F.transform(segments, lambda s: F.trim(s["text"])), " ")
    count = F.aggregate(segments, F.lit(0), lambda a, s: a + F.coalesce(F.size(F.nullif(s["words"], F.array())), F.lit(0)))
    return [raw.alias("raw_text"), count.cast("long").alias("word_count"), F.char_length(raw).cast("long").alias("char_count"), F.size(segments).cast("long").alias("segment_count")]


def token_totals(chunks: DataFrame, by: str, tokens: str = "tokens") -> DataFrame:
    """(by, total_tokens, chunk_count, failed): the total is null where the tokens of a chunk are unknown."""
    failed = F.count_if(F.col(tokens).isNull())
    return chunks.groupBy(by).agg(F.when(failed == 0, F.sum(tokens)).alias("total_tokens"), F.count("*").alias("chunk_count"), failed.alias("failed"))


def flags(json: Column) -> Column:
    """A JSON object of known capabilities and whether each is there; null if none is left."""
    return _known(F.from_json(json, FLAGS))


def reasons(json: Column) -> Column:
    """A JSON object of known capabilities and why each was left out; null if none is left."""
    return _known(F.from_json(json, REASONS))


def _known(m: Column) -> Column:
    kept = F.map_filter(m, lambda k, v: k.isin(*CAPABILITIES))
    return F.when(F.size(kept) > 0, kept)


def capability_descriptor(segments: Column, speakers: Column, biasing_asked: Column, biasing_done: Column, diarization_asked: Column) -> list[Column]:
    """caps_applied, caps_requested and caps_skipped_reason of a run, from what it did: words have times on every run
    and are always asked for; nothing asks for word scores or the language, which this kind of model hasn't."""
    times = F.exists(segments, lambda s: F.coalesce(F.size(s["words"]) > 0, F.lit(False)))
    diarized = diarization_asked & speakers.isNotNull()
    false, true = F.lit(False), F.lit(True)
    names = F.array(*map(F.lit, CAPABILITIES))
    applied = F.map_from_arrays(names, F.array(times, biasing_done, diarized, false, false))
    asked = F.map_from_arrays(names, F.array(true, biasing_asked, diarization_asked, false, false))
    requested = F.map_filter(asked, lambda k, v: v)
    why = F.map_from_arrays(names, F.array(F.lit("no word times"), F.lit("biasing is off"), F.lit("no speakers found"), F.lit(""), F.lit("")))
    skipped = F.map_filter(why, lambda k, v: F.coalesce(F.element_at(asked, k), false) & ~F.coalesce(F.element_at(applied, k), false))
    return [applied.alias("caps_applied"), requested.alias("caps_requested"), F.when(F.size(skipped) > 0, skipped).alias("caps_skipped_reason")]


def window_count(duration: Column, window_s: float) -> Column:
    """How many windows cover a duration, one at least."""
    return F.greatest(F.lit(1), F.ceil(duration / window_s)).cast("long")


def with_slices(metrics: DataFrame, slices: list[DataFrame], key: str = "job_id") -> DataFrame:
    """metrics (one row a key) after the slices, in turn: each overwrites its own columns only, for the keys it has."""

    def put(old: DataFrame, new: DataFrame) -> DataFrame:
        own = [c for c in new.columns if c != key]
        n = new.select(F.col(key).alias("_key"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in own])
        both = old.join(n, F.col(key) == F.col("_key"), "full_outer")
        pick = lambda c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c) if c in old.columns else F.lit(None)).alias(c)
        rest = [c for c in old.columns if c != key and c not in own]
        return both.select(F.coalesce(key, "_key").alias(key), *rest, *map(pick, own))

    return reduce(put, slices, metrics)


def event_rows(rows: DataFrame, detail: list[str]) -> DataFrame:
    """rows as events to append: empty strings are null, and the detail columns become one JSON object, if any is set."""
    others = [c for c in rows.columns if c not in detail]
    told = [F.nullif(F.col(c), F.lit("")).alias(c) if rows.schema[c].dataType.typeName() == "string" else F.col(c) for c in others]
    some = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in detail])
    return rows.select(*told, F.when(some, F.to_json(F.struct(*detail))).alias("detail"))


def known(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """The keys asked for, with whether rows has them."""
    there = rows.select(F.col(key).alias("_key")).distinct().withColumn("_there", F.lit(True))
    return asked.join(there, F.col(key) == F.col("_key"), "left").select(key, F.col("_there").isNotNull().alias("known"))
