"""Choosing chunks to judge, and a transcript's way from segments to corrected, embedded chunks.

Judge and embedder are given as functions over pandas columns, so that a model's client can stand in their place; the
ones here are deterministic stand-ins without a network. They run inside Spark's tasks over Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoshelf.functions.text import contains_wild
from sonoshelf.session import bound_batches

from . import chunking, findings, overlay

BOOK_LIMIT, SAMPLE_LIMIT = 200, 50
#: Prefixes of texts for models that were trained with them.
DOCUMENT_PREFIX, QUERY_PREFIX = "search_document: ", "search_query: "
Judge = Callable[[pd.Series], pd.Series]
Embedder = Callable[[list[str]], list[list[float]]]


def judged_text(chunks: DataFrame) -> Column:
    """What is judged: a chunk's pristine text, where it is kept apart."""
    return F.coalesce("source_text", "text") if "source_text" in chunks.columns else F.col("text")


def of_book(chunks: DataFrame, transcripts: DataFrame, part: str, limit: int = 0) -> DataFrame:
    """Chunks with their job whose path holds part, in order of path and place, at most limit (200 if not positive)."""
    rows = chunks.where(contains_wild(F.col("file_path"), part)).withColumn("text", judged_text(chunks))
    rows = rows.join(transcripts.select(F.col("id").alias("transcript_id"), "job_id"), "transcript_id")
    return rows.orderBy("file_path", "chunk_index", "id").limit(limit if limit > 0 else BOOK_LIMIT)


def sample(chunks: DataFrame, transcripts: DataFrame, limit: int = 0, seed: int = 0) -> DataFrame:
    """A sample of limit chunks (50 if not positive) of the whole library, the same for the same seed and rows however
    they are dealt: those with the smallest hashes of seed and id. No sort of everything, but the top of each task."""
    rows = chunks.withColumn("text", judged_text(chunks)).withColumn("_h", F.xxhash64(F.lit(seed), "id"))
    picked = rows.orderBy("_h", "id").limit(limit if limit > 0 else SAMPLE_LIMIT).drop("_h")
    return picked.join(transcripts.select(F.col("id").alias("transcript_id"), "job_id"), "transcript_id")


def unevaluated(jobs: DataFrame, transcripts: DataFrame, metrics: DataFrame) -> DataFrame:
    """Transcripts of done jobs that weren't evaluated, whether they are embedded or not, the oldest first."""
    judged = metrics.where("eval_finished_at is not null").select("job_id")
    done = transcripts.join(jobs.where("status = 'done'").select(F.col("id").alias("job_id")), "job_id", "left_semi")
    return done.join(judged, "job_id", "left_anti").orderBy("created_at", "id")


def repeated_word_judge(text: pd.Series) -> pd.Series:
    """A stand-in: its answer tells of the first word that is said twice in a row."""

    def told(t: str) -> str:
        w = t.split()
        at = next((i for i in range(1, len(w)) if w[i] == w[i - 1] and '"' not in w[i] and "\\" not in w[i]), None)
        if at is None:
            return '{"findings": []}'
        return f'Sure: {{"findings": [{{"original_text": "{w[at]} {w[at]}", "issue_type": "Repeated_Text ", "suggested_correction": "{w[at]}", "confidence": 0.9, "anchor_offset": -1}}]}}'

    return text.fillna("").map(told)


def judge(chunks: DataFrame, ask: Judge = repeated_word_judge, *, floor: float = findings.FLOOR, most: int = findings.PER_CHUNK) -> DataFrame:
    """Proposed findings of a judge on chunks (id, transcript_id, chunk_index, start_sec, text): parsed, none below the
    floor, the surest of each chunk. An answer that can't be parsed gives none."""
    bound_batches(chunks.sparkSession)
    asked = F.pandas_udf(ask, "string")
    told = chunks.select("id", "transcript_id", "chunk_index", "start_sec", F.sha2("text", 256).alias("chunk_text_sha256"), F.explode(findings.parse_judgement(asked("text"))).alias("f"))
    rows = told.select(F.col("id").alias("chunk_id"), "transcript_id", "chunk_index", "start_sec", "chunk_text_sha256", "f.*").where(F.col("confidence") >= floor)
    rows = rows.withColumn("id", F.xxhash64("chunk_id", "original_text", "suggested_correction", "issue_type")).withColumn("patch_state", F.lit("proposed"))
    return findings.top_per_chunk(rows.dropDuplicates(["id"]), most)


def needs_prefix(model: str) -> bool:
    return "nomic" in model.lower()


def hashing_embedder(texts: list[str], dims: int = 64) -> list[list[float]]:
    """A stand-in: signed counts of words by the hash of each, of length one."""
    out = np.zeros((len(texts), dims))
    for k, t in enumerate(texts):
        for w in t.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[k, h % dims] += 1 if h >> 63 else -1
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(size > 0, size, 1)).tolist()


def embedded(chunks: DataFrame, embed: Embedder = hashing_embedder, model: str = "hashing", text: str = "text") -> DataFrame:
    """chunks with embedding, batch by batch; a batch that comes back with another number of vectors is an error."""
    bound_batches(chunks.sparkSession)
    prefix = DOCUMENT_PREFIX if needs_prefix(model) else ""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            vectors = embed([prefix + (t or "") for t in batch])
            if len(vectors) != len(batch):
                raise ValueError(f"{len(batch)} texts gave {len(vectors)} vectors")
            yield pd.Series(vectors)

    def column(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return run(texts)

    column.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return chunks.withColumn("embedding", F.pandas_udf(column, "array<double>")(text))


def query_vector(text: str, embed: Embedder = hashing_embedder, model: str = "hashing") -> list[float]:
    return embed([(QUERY_PREFIX if needs_prefix(model) else "") + text])[0]


def processed(transcripts: DataFrame, found: DataFrame, ask: Judge = repeated_word_judge, embed: Embedder = hashing_embedder, size: int = chunking.TOKENS) -> dict[str, DataFrame]:
    """processed_chunks of the chunks of transcripts (id, segments)."""
    return processed_chunks(chunking.chunk_rows(transcripts, size), found, ask, embed)


def processed_chunks(made: DataFrame, found: DataFrame, ask: Judge = repeated_word_judge, embed: Embedder = hashing_embedder) -> dict[str, DataFrame]:
    """What becomes of transcripts whose chunks are made as chunk_rows has them: the pristine chunks, the judge's findings
    on them, the text under the corrections of found that are accepted or applied, its vectors, and the outcomes of those
    corrections. Several of these steps read made and found, so tables that are written spare making them anew.

    chunks: id, transcript_id, chunk_index, start_sec, end_sec, source_text, text, speaker, embedding, embedding_stale.
    """
    made = made.withColumnsRenamed({"start": "start_sec", "end": "end_sec"})
    wanted = made.select("transcript_id").distinct()
    patches = findings.overlay_of(found).join(wanted, "transcript_id", "left_semi").select(
        "transcript_id", "chunk_index", "id", F.col("original_text").alias("span"), F.col("suggested_correction").alias("correction"), F.col("chunk_text_sha256").alias("sha256"),
        F.col("anchor_offset").cast("int").alias("offset"), F.col("anchor_occurrence").cast("int").alias("occurrence"),
    )
    replayed = overlay.corrected(made, patches)
    pristine = made.withColumnRenamed("text", "source_text")
    chunks = pristine.join(replayed.select("transcript_id", "chunk_index", "text"), ["transcript_id", "chunk_index"])
    return {
        "chunks": embedded(chunks, embed).withColumn("embedding_stale", F.lit(False)),
        "findings": judge(made, ask),
        "outcomes": overlay.outcomes(replayed, made, patches),
    }


def resegmented(transcripts: DataFrame, apply: bool = False) -> tuple[DataFrame, DataFrame]:
    """(transcripts after, one row of counts) of cutting the words of stored segments anew. A transcript whose words are
    missing keeps its segments, and so does one whose number of segments stays; without apply all do."""
    bound_batches(transcripts.sparkSession)
    found = F.flatten(F.transform("segments", lambda s: F.coalesce(s["words"], F.array())))
    rows = transcripts.withColumn("_new", chunking.to_segments(found))
    before, after = F.size("segments"), F.size("_new")
    empty, changed = (after == 0) & (before > 0), (after > 0) & (after != before)
    counts = rows.agg(
        F.count("*").alias("transcripts"), F.count_if(changed).alias("changed"), F.count_if(changed & F.lit(apply)).alias("written"), F.count_if(empty).alias("skipped_empty"),
        F.sum(before).alias("segments_before"), F.sum(F.when(empty, before).otherwise(after)).alias("segments_after"),
    )
    out = rows.withColumn("segments", F.when(changed, F.col("_new")).otherwise(F.col("segments"))) if apply else rows
    return out.drop("_new"), counts
