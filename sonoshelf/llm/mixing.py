"""Mixing sources to target weights by hash thresholds, without sorting documents.

Every document has a 60-bit hash of its id. Copy k of a source's documents goes to those whose hash is at most a
threshold, and the thresholds are nested: a source's budget fills whole copies first and one threshold for the
rest. That threshold is found from histograms of words by source and the next 12 bits of the hash: the bucket in
which the budget ends is refined, and only that one, until it holds a single hash.

Defined results: a null or empty text has no words; a null source is a source of its own, ordered last; a null id
is hashed as empty text; rows that repeat an id share its hash, so they are taken together; sources without words
have target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stow, text_or_empty, unused

HASH_BITS = 60
STEP_BITS = 12
MAX_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text_col: str = "text"):
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def id_hash(id_col: str = "doc_id"):
    """The first 60 bits of the MD5 of the id as text."""
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(key, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, size). Weights repeat over the sources by code point, null last.

    The targets are what pouring the total into the sources by weight gives, when a source holds max_repeats times
    its size: those which fill up stay at that, and the others stand at one common level of words per weight. The
    windows run over one row per source.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("rank", F.row_number().over(w)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    by = by.withColumn("most", F.col("source_size") * max_repeats).withColumn("full_at", F.col("most").cast("double") / F.col("weight"))
    fill = Window.orderBy("full_at", "rank")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.coalesce(F.sum("most").over(before), F.lit(0))
    by = by.withColumn("level", left.cast("double") / F.sum("weight").over(after)).withColumn("place", F.row_number().over(fill))
    level = F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("place", "level"))).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return by.withColumn("stands", level).select("source", "source_size", F.least(F.col("most").cast("double"), F.col("weight") * F.col("stands.level")).alias("target"))


def _by_source(left: DataFrame, right: DataFrame, small: bool) -> DataFrame:
    right = right.withColumnRenamed("source", "_of")
    return left.join(F.broadcast(right) if small else right, left["source"].eqNullSafe(right["_of"])).drop("_of")


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, most_hash): a document is taken whole times, and once more if its hash
    is at most most_hash. sized: (source, size, h)."""
    small = targets.count() <= BROADCAST_ROWS
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    state = state.withColumn("prefix", F.lit(0).cast("long")).withColumn("before", F.lit(0).cast("long")).withColumn("settled", F.col("rest") <= 0).withColumn("most_hash", F.lit(-1).cast("long"))
    state = stow(state, "mix")
    in_order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        open_ = state.where(~F.col("settled"))
        here = _by_source(sized, open_.select("source", "prefix", "before", "rest"), small).where(F.shiftright("h", shift + STEP_BITS) == F.col("prefix"))
        here = here.groupBy("source", "before", "rest", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("mass"), F.min("h").alias("low"), F.max("h").alias("high"))
        ends = here.withColumn("upto", F.col("before") + F.sum("mass").over(in_order)).where(F.col("upto") >= F.col("rest"))
        ends = ends.groupBy("source").agg(F.min(F.struct("bucket", "upto", "mass", "low", "high")).alias("b"))
        found = _by_source(open_, ends, small)
        under = F.col("b.upto") - F.col("b.mass")
        one = F.col("b.low") == F.col("b.high")
        nearer = (F.col("b.upto") - F.col("rest")) < (F.col("rest") - under)
        found = found.select("source", "source_size", "target", "whole", "rest", F.col("b.bucket").alias("prefix"), under.alias("before"), one.alias("settled"), F.when(one, F.when(nearer, F.col("b.high")).otherwise(F.col("b.high") - 1)).otherwise(-1).alias("most_hash"))
        state = stow(state.where("settled").unionByName(found), "mix")
        if state.where(~F.col("settled")).isEmpty():
            break
    return state.select("source", "source_size", "target", "whole", "most_hash")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per row of documents: doc_id, size, source_size, target, copies and taken (copies times size)."""
    sized = stow(docs.select("doc_id", "source", word_count().alias("size"), id_hash().alias("h")), "sized")
    marks = thresholds(sized, source_targets(sized, weights, max_repeats))
    out = _by_source(sized, marks, marks.count() <= BROADCAST_ROWS)
    copies = F.col("whole") + (F.col("h") <= F.col("most_hash")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mixed table: each row of docs as many times as the mix takes it. Rows without words follow their hash too."""
    h, copies, n = unused(docs.columns, "h", "copies", "n")
    sized = stow(docs.select("source", word_count().alias("size"), id_hash().alias("h")), "sized")
    marks = thresholds(sized, source_targets(sized, weights, max_repeats)).select(F.col("source").alias(f"{h}_of"), "whole", "most_hash")
    marks = marks.withColumnsRenamed({"whole": f"{h}_whole", "most_hash": f"{h}_most"})
    small = marks.count() <= BROADCAST_ROWS
    out = docs.join(F.broadcast(marks) if small else marks, docs["source"].eqNullSafe(marks[f"{h}_of"])).withColumn(h, id_hash())
    out = out.withColumn(copies, (F.col(f"{h}_whole") + (F.col(h) <= F.col(f"{h}_most")).cast("long")).cast("int"))
    return out.where(F.col(copies) > 0).withColumn(n, F.explode(F.array_repeat(F.lit(0), F.col(copies)))).select(docs.columns)
