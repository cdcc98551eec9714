"""Corrections on pristine text: where a span is, and what the text is after all corrections that still fit.

Everything is by code points. A correction names the text it was made for by hash, the span, and where it was seen;
replay applies those that fit from the end of the text to its start, and every correction ends up applied or stale.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def occurrences(text: str, span: str) -> list[int]:
    """Where a span starts in a text, also within one before."""
    out, at = [], text.find(span) if span else -1
    while at >= 0:
        out.append(at)
        at = text.find(span, at + 1)
    return out


def locate(text: str, span: str, offset: int | None = None, occurrence: int | None = None) -> tuple[int | None, str]:
    """(start, status): the offset if the span is there, else the occurrence from 0, else the only one."""
    if offset is not None and span and text[offset : offset + len(span)] == span and offset >= 0:
        return offset, "offset"
    at = occurrences(text, span)
    if not at:
        return None, "not found"
    if occurrence is not None and 0 <= occurrence < len(at):
        return at[occurrence], "occurrence"
    return (at[0], "unique") if len(at) == 1 else (None, "ambiguous")


def text_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _number(x) -> int | None:
    return None if x is None or x != x else int(x)


def replay(text: str, patches: list[dict]) -> tuple[str, list, dict]:
    """(text, ids applied, {id: why it is stale}), whatever the order of patches.

    A patch has id, span, correction, sha256, offset and occurrence. Two neighbours that overlap, in descending order
    of their starts, are both stale; a third one between the ends of the first is held against its neighbour only.
    """
    stale, placed, digest = {}, [], text_hash(text)
    for p in sorted(patches, key=lambda p: str(p["id"])):
        at, status = locate(text, p["span"] or "", _number(p["offset"]), _number(p["occurrence"]))
        if not (p["correction"] or "").strip():
            stale[p["id"]] = "empty correction"
        elif p["sha256"] and p["sha256"] != digest:
            stale[p["id"]] = "text changed"
        elif at is None:
            stale[p["id"]] = status
        else:
            placed.append((at, at + len(p["span"]), str(p["id"]), p))
    placed.sort(key=lambda x: (-x[0], -x[1], x[2]))
    overlap = {y[3]["id"] for a, b in pairwise(placed) if b[1] > a[0] for y in (a, b)}
    stale |= dict.fromkeys(overlap, "overlap")
    applied = []
    for start, end, _, p in placed:
        if p["id"] not in overlap:
            text = text[:start] + p["correction"] + text[end:]
            applied.append(p["id"])
    return text, sorted(applied, key=str), stale


def apply_all(text: str, patches: list[dict]) -> str:
    """The text under all patches; an error if one of them doesn't fit."""
    out, _, stale = replay(text, patches)
    if stale:
        raise ValueError(f"corrections that don't fit: {stale}")
    return out


RESULT = "transcript_id long, chunk_index int, text string, applied array<long>, stale map<long,string>"
PATCH = ("id", "span", "correction", "sha256", "offset", "occurrence")


def corrected(chunks: DataFrame, patches: DataFrame) -> DataFrame:
    """(transcript_id, chunk_index, text, applied, stale) of chunks (transcript_id, chunk_index, text) under patches
    (transcript_id, chunk_index, id, span, correction, sha256, offset, occurrence). Only a chunk's own patches meet it:
    they are gathered by chunk and joined, and chunks without any don't reach Python."""
    by = ["transcript_id", "chunk_index"]
    lists = patches.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*PATCH))).alias("patches"))
    joined = chunks.select(*by, "text").join(lists, by, "left")

    def run(frames):
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                text, applied, stale = replay(r["text"] or "", list(r["patches"]))
                rows.append((r["transcript_id"], r["chunk_index"], text, applied, stale))
            yield pd.DataFrame(rows, columns=["transcript_id", "chunk_index", "text", "applied", "stale"])

    plain = joined.where("patches is null").select(*by, "text", F.array().cast("array<long>").alias("applied"), F.create_map().cast("map<long,string>").alias("stale"))
    return plain.unionByName(joined.where("patches is not null").mapInPandas(run, RESULT))


def outcomes(replayed: DataFrame, chunks: DataFrame, patches: DataFrame) -> DataFrame:
    """(id, state, reason) of every patch: applied, stale, and stale too where its chunk is gone."""
    applied = replayed.select(F.explode("applied").alias("id"), F.lit("applied").alias("state"), F.lit(None).cast("string").alias("reason"))
    stale = replayed.select(F.explode("stale").alias("id", "reason")).select("id", F.lit("stale").alias("state"), "reason")
    gone = orphans(chunks, patches).select("id", F.lit("stale").alias("state"), F.lit("chunk gone").alias("reason"))
    return applied.unionByName(stale).unionByName(gone)


def orphans(chunks: DataFrame, patches: DataFrame) -> DataFrame:
    """The patches of chunks that don't exist."""
    return patches.join(chunks, ["transcript_id", "chunk_index"], "left_anti")


class EditPlan(NamedTuple):
    """A direct edit that may be recorded: where it is, which of the equal spans it takes, the hash of the text it was
    made for, the text after it and all other corrections, and which of those don't fit and why."""

    start: int
    end: int
    occurrence: int
    sha256: str
    preview: str
    stale: dict


def plan_edit(text: str, edit: dict, existing: list[dict]) -> tuple[EditPlan | None, str]:
    """(plan, status) of a direct edit of a pristine text, beside the corrections that are accepted or applied there.

    edit is a patch as in replay, with an id of its own; without sha256 it is for the text as it is. It must not touch a
    correction that is replayed on this text; one that no longer fits occupies no place. The plan's place and occurrence
    are where the span was found, not where it was said to be."""
    digest = text_hash(text)
    if not (edit["correction"] or "").strip():
        return None, "empty correction"
    if edit.get("sha256") and edit["sha256"] != digest:
        return None, "text changed"
    span = edit["span"] or ""
    at, status = locate(text, span, _number(edit.get("offset")), _number(edit.get("occurrence")))
    if at is None:
        return None, status
    _, applied, stale = replay(text, existing)
    for p in existing:
        if p["id"] in applied:
            start, _ = locate(text, p["span"], _number(p["offset"]), _number(p["occurrence"]))
            if start < at + len(span) and at < start + len(p["span"]):
                return None, "overlap"
    preview, _, _ = replay(text, [*existing, {"offset": None, "occurrence": None, **edit, "sha256": digest}])
    return EditPlan(at, at + len(span), occurrences(text, span).index(at), digest, preview, stale), "ok"


EDIT = "id long, transcript_id long, chunk_index int, status string, start int, occurrence int, chunk_text_sha256 string, preview string, stale map<long,string>"
# Fixed values of a correction that a person made.
MANUAL = {"confidence": 1.0, "model": "manual", "origin": "human", "patch_state": "accepted"}


def planned_edits(edits: DataFrame, chunks: DataFrame, patches: DataFrame) -> DataFrame:
    """(id, transcript_id, chunk_index, status, start, occurrence, chunk_text_sha256, preview, stale) of each edit (id,
    transcript_id, chunk_index, span, correction, sha256, offset, occurrence) as plan_edit has it, on chunks
    (transcript_id, chunk_index, text, and source_text where a text was corrected) under their patches. Each edit is
    planned for itself; one without a chunk has the status "chunk gone"."""
    by = ["transcript_id", "chunk_index"]
    lists = patches.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*PATCH))).alias("patches"))
    asked = edits.select(*by, F.struct(*PATCH).alias("edit"))
    rows = asked.join(chunks.select(*by, F.coalesce("source_text", "text").alias("text")), by, "left").join(lists, by, "left")

    def run(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                e = dict(r["edit"])
                plan, status = (None, "chunk gone") if r["text"] is None else plan_edit(r["text"], e, [dict(p) for p in r["patches"]] if r["patches"] is not None else [])
                told = (plan.start, plan.occurrence, plan.sha256, plan.preview, plan.stale) if plan else (None,) * 5
                out.append((e["id"], r["transcript_id"], r["chunk_index"], status, *told))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in EDIT.split(", ")]).astype({"start": "Int32", "occurrence": "Int32"})

    return rows.mapInPandas(run, EDIT)


def record_edits(findings: DataFrame, planned: DataFrame, edits: DataFrame, chunks: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(findings, chunks) after the planned edits are recorded as accepted corrections by hand, and their chunks flagged
    to be embedded again. An edit is recorded only if its chunk's pristine text still has the hash it was planned for;
    findings' columns that an edit has no value for are null."""
    by = ["transcript_id", "chunk_index"]
    now = chunks.select(*by, F.sha2(F.coalesce("source_text", "text").cast("binary"), 256).alias("chunk_text_sha256")).distinct()
    good = planned.where("status = 'ok'").join(now, [*by, "chunk_text_sha256"], "left_semi")
    rows = good.join(edits.select("id", "span", "correction", *[c for c in ("issue_type", "decided_by") if c in edits.columns]), "id")
    values = {c: F.lit(v) for c, v in MANUAL.items()} | {"id": F.col("id"), "transcript_id": F.col("transcript_id"), "chunk_index": F.col("chunk_index"), "original_text": F.col("span"), "suggested_correction": F.col("correction")}
    values |= {"anchor_offset": F.col("start"), "anchor_occurrence": F.col("occurrence"), "chunk_text_sha256": F.col("chunk_text_sha256"), "decided_at": as_of}
    values |= {c: F.nullif(F.col(c), F.lit("")) for c in ("issue_type", "decided_by") if c in edits.columns}
    new = rows.select(*[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in findings.dtypes])
    flagged = chunks.join(good.select(*by).distinct().withColumn("_edited", F.lit(True)), by, "left")
    flagged = flagged.withColumn("embedding_stale", F.coalesce("_edited", "embedding_stale")).select(chunks.columns)
    return findings.unionByName(new), flagged
