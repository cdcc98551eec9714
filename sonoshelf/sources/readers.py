"""Reading the library's inputs: audio trees, sidecar metadata, catalogue exports, transcripts as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoshelf.functions.text import is_audio_file

WORDS = "array<struct<word:string,start:double,end:double,score:double,speaker:string>>"
SEGMENTS = f"array<struct<id:int,start:double,end:double,text:string,speaker:string,words:{WORDS}>>"
CHAPTERS = "array<struct<index:int,title:string,start_sec:double,end_sec:double>>"
SCHEMAS = {
    "jobs": "id string, file_path string, checksum string, status string, claimed_by string, claimed_at timestamp, created_at timestamp, updated_at timestamp, completed_at timestamp, error string, attempts int",
    "transcripts": f"id string, job_id string, file_path string, checksum string, language string, duration_seconds double, speaker_count int, raw_text string, model_name string, created_at timestamp, segments {SEGMENTS}",
    "chunks": "id string, transcript_id string, file_path string, chunk_index int, start_sec double, end_sec double, text string, source_text string, speaker string, embedding array<float>, embedding_stale boolean, created_at timestamp",
    "book_metadata": f"book_dir string, title string, author string, narrator string, series string, asin string, chapters {CHAPTERS}, bias_terms array<string>, source string, updated_at timestamp",
    "run_metrics": "job_id string, audio_bytes bigint, transcribe_started_at timestamp, transcribe_finished_at timestamp, word_count bigint, char_count bigint, segment_count bigint, mean_word_confidence double, runner_host string, model_name string, caps_applied map<string,boolean>, caps_requested map<string,boolean>, caps_skipped_reason map<string,string>, embed_started_at timestamp, embed_finished_at timestamp, embed_model string, embed_chunk_count int, embed_prompt_tokens bigint, embed_total_tokens bigint, eval_finished_at timestamp, eval_findings int",
    "findings": "id string, chunk_id string, transcript_id string, job_id string, file_path string, chunk_index int, start_sec double, end_sec double, original_text string, issue_type string, suggested_correction string, confidence double, anchor_offset int, anchor_occurrence int, chunk_text_sha256 string, patch_state string, decided_by string, decided_at timestamp, applied_at timestamp, stale_reason string, created_at timestamp",
    "events": "id string, job_id string, stage string, status string, runner_host string, reason string, detail string, duration double, created_at timestamp",
    "control": "id int, paused boolean, run_limit int, phase string, runner_heartbeat_at timestamp, runner_version string, desired_runner_version string, updated_at timestamp",
}


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the library with its declared schema; columns that older files lack are null."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def audio_files(spark: SparkSession, root: str, checksum: bool = False) -> DataFrame:
    """(path, length, modified[, sha256]) of the audio files under root. The content is only read for the checksum."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(is_audio_file(F.col("path")))
    out = f.select("path", "length", F.col("modificationTime").alias("modified"), *([F.sha2("content", 256).alias("sha256")] if checksum else []))
    return out


def scan_counts(spark: SparkSession, root: str) -> DataFrame:
    """One row: the files under root that were walked, those that are audio and those skipped; hidden files, resource
    forks among them, aren't walked. A root that isn't there is an error."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path").agg(
        F.count("*").alias("walked"), F.count_if(is_audio_file(F.col("path"))).alias("audio"), F.count_if(~is_audio_file(F.col("path"))).alias("skipped")
    )


def settled(before: DataFrame, now: DataFrame) -> DataFrame:
    """The files of now (path, length, seen) with seen, the number of looks in a row that found the same length."""
    old = before.select(F.col("path").alias("_path"), F.col("length").alias("_length"), F.col("seen").alias("_seen"))
    same = F.col("_length") == F.col("length")
    return now.join(old, F.col("path") == F.col("_path"), "left").select("path", "length", F.when(same, F.col("_seen") + 1).otherwise(1).alias("seen"))


# The providers of metadata.
PROVIDERS = ("path", "abs")


def providers(setting: str) -> list[str]:
    """The providers that a setting names, in order: one of them, or "chain:" and several; path for anything else."""
    kind, _, rest = setting.strip().lower().partition(":")
    names = [n.strip() for n in rest.split(",")] if kind == "chain" else [kind]
    return list(dict.fromkeys(n for n in names if n in PROVIDERS)) or ["path"]


def decoded(column: Column, kind: str) -> Column:
    """Nested values from JSON text; text that isn't such JSON is an error."""
    return F.from_json(column, kind, {"mode": "FAILFAST"})


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, author, narrator, isbn, asin) of metadata.json files of either format; isbn may be a number."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), "value")
    one = lambda *keys: F.coalesce(*[F.get_json_object("value", f"$.{k}") for k in keys])
    number = F.when(one("isbn").rlike(r"^[0-9.]+[eE][+]?[0-9]+$|^[0-9]+\.0$"), F.format_string("%.0f", one("isbn").cast("double"))).otherwise(one("isbn"))
    return raw.select("path", one("title", "book.title").alias("title"), one("authors[0].name", "authors[0]", "author").alias("author"), one("narrators[0].name", "narrators[0]", "narrator").alias("narrator"), number.alias("isbn"), F.upper(one("asin")).alias("asin"))


def catalogue_items(spark: SparkSession, path: str) -> DataFrame:
    """(asin, title, author, chapters) from exported pages of a library catalogue, {"results": [...]} a line."""
    kind = f"results array<struct<asin:string,title:string,author:string,chapters:{CHAPTERS}>>"
    pages = spark.read.schema(kind).json(path)
    return pages.select(F.explode("results").alias("r")).select(F.upper("r.asin").alias("asin"), "r.title", "r.author", "r.chapters")


def first_found(base: DataFrame, key: str, providers: list[DataFrame]) -> DataFrame:
    """base with title, author and chapters from the first provider whose row has any of them, as a whole row."""
    out, picks = base, []
    for k, p in enumerate(providers):
        row = F.struct("title", "author", "chapters")
        some = (F.coalesce("title", F.lit("")) != "") | (F.coalesce("author", F.lit("")) != "") | (F.coalesce(F.size("chapters"), F.lit(0)) > 0)
        out = out.join(p.where(some).select(F.col(key).alias(f"_k{k}"), row.alias(f"_p{k}")), F.col(key) == F.col(f"_k{k}"), "left")
        picks.append(F.col(f"_p{k}"))
    return out.withColumn("_pick", F.coalesce(*picks)).select(base["*"], "_pick.title", "_pick.author", "_pick.chapters")
