"""The corrections worklist: each finding with where its span stands in its chunk and the text around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoshelf.functions.text import around

from .findings import TRANSITIONS, with_chunk

DEFAULT_LIMIT, MOST = 50, 200


def starts(text: Column, span: Column) -> Column:
    """Where a span starts in a text, also within one before."""
    last = F.length(text) - F.length(span)
    at = F.filter(F.sequence(F.lit(0), last), lambda i: F.substring(text, i + 1, F.length(span)) == span)
    return F.when((F.length(span) > 0) & (last >= 0) & F.contains(text, span), at).otherwise(F.array().cast("array<int>"))


def anchor(text: Column, span: Column, offset: Column, occurrence: Column | None = None) -> Column:
    """(start, status): at the offset if the span is there, else at the occurrence, which counts from 0, else where it
    stands if that is one place only."""
    occurrence = F.lit(None).cast("int") if occurrence is None else occurrence
    there = F.coalesce(F.substring(text, offset + 1, F.length(span)) == span, F.lit(False)) & (F.length(span) > 0) & F.coalesce(offset >= 0, F.lit(False))

    def told(at: Column) -> Column:
        nth = F.coalesce((occurrence >= 0) & (occurrence < F.size(at)), F.lit(False))
        start = F.when(there, offset).when(nth, F.get(at, occurrence)).when(F.size(at) == 1, F.get(at, F.lit(0)))
        status = F.when(text.isNull(), "no chunk").when(there, "offset").when(F.size(at) == 0, "not found").when(nth, "occurrence").when(F.size(at) == 1, "unique").otherwise("ambiguous")
        return F.struct(start.cast("int").alias("start"), status.alias("status"))

    return F.transform(F.array(starts(text, span)), told)[0]


def corrections(found: DataFrame, chunks: DataFrame, *, states: list[str] | None = None, floor: float = 0.0, scope: Column | None = None, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """A page of corrections, the surest first, with their chunk's text around the span and what they may become. The
    page is cut before chunks are joined."""
    if not 0 <= floor <= 1:
        raise ValueError(f"floor must be from 0 to 1, not {floor}")
    if bad := set(states or ()) - TRANSITIONS.keys():
        raise ValueError(f"unknown states {sorted(bad)}")
    rows = found.where(F.col("confidence") >= floor) if floor else found
    rows = rows.where(F.col("patch_state").isin(states)) if states else rows
    rows = rows.where(scope) if scope is not None else rows
    page = rows.orderBy(F.desc("confidence"), "transcript_id", "start_sec", "id").offset(max(0, offset)).limit(min(max(1, limit), MOST))
    out = with_chunk(page, chunks)
    out = out.withColumn("anchor", anchor(F.col("chunk_text"), F.col("original_text"), F.col("anchor_offset"), F.col("anchor_occurrence") if "anchor_occurrence" in out.columns else None))
    end = F.col("anchor.start") + F.length("original_text")
    shown = F.when(F.col("anchor.start").isNotNull(), around(F.col("chunk_text"), F.col("anchor.start"), end)).otherwise(
        F.struct(F.substring("chunk_text", 1, 600).alias("context"), (F.length("chunk_text") > 600).alias("truncated"))
    )
    legal = F.create_map(*[F.lit(x) for s, to in sorted(TRANSITIONS.items()) for x in (s, ",".join(sorted(to)))])
    return out.withColumn("shown", shown).withColumn("may_become", F.split(legal[F.col("patch_state")], ",")).select("id", "confidence", "patch_state", "anchor.start", "anchor.status", "shown.context", "shown.truncated", "may_become")
