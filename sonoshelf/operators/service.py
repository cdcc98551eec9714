"""What people and monitors see of the whole: a status snapshot, feeds, one book's page, and which book was meant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoshelf.functions.text import asin, book_dir, contains_exact, without_asin

from . import library, pipeline, status

QUEUE_ROWS, ACTIVITY_ROWS = 20, 12
#: So many candidates are looked at when a book is named.
CANDIDATES = 200


def in_book(path: Column, directory: str) -> Column:
    """Whether a path lies below a directory; the directory's characters stand for themselves. It reaches the scan."""
    return path.startswith(directory.rstrip("/") + "/")


def snapshot(jobs: DataFrame, transcripts: DataFrame, chunks: DataFrame, metrics: DataFrame, log: DataFrame, control: DataFrame, as_of: Column, *, stage: str = "runner_availability", idle: str = "idle") -> DataFrame:
    """The service's status as one row.

    jobs (id, status, claimed_by, updated_at, completed_at, file_path), transcripts (id, job_id, duration_seconds),
    chunks (transcript_id, created_at), metrics (job_id, eval_finished_at, transcribe_started_at,
    transcribe_finished_at, embed_finished_at, embed_total_tokens, word_count), log (stage, created_at, reason, detail)
    and control, a row of settings at most. Every part is an aggregate of one row, and all are put side by side."""
    finished = F.coalesce("completed_at", "updated_at")
    recent = finished > as_of - F.expr("interval 1 hour")
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    by_job = jobs.agg(
        n("pending"), n("claimed"), n("done"), n("failed"), F.count_if(F.col("status").isin("pending", "claimed", "done", "failed")).alias("total_jobs"),
        F.count_if((F.col("status") == "done") & recent).alias("done_last_hour"), F.expr("max_by(struct(claimed_by, updated_at), struct(updated_at, claimed_by)) FILTER (WHERE status = 'claimed')").alias("claim"),
        F.greatest(F.max(F.when(F.col("status") == "claimed", F.col("updated_at"))), F.max(F.when(F.col("status") == "done", finished))).alias("latest_activity"),
    )
    by_job = by_job.withColumn("runner_active", F.col("claim.claimed_by").isNotNull()).withColumn("runner_id", F.col("claim.claimed_by")).withColumn("last_heartbeat", F.col("claim.updated_at")).drop("claim")
    of_transcripts = transcripts.agg(F.count("*").alias("transcripts"), F.sum("duration_seconds").alias("total_duration_seconds"))
    of_chunks = chunks.agg(F.count("*").alias("chunks"), F.max("created_at").alias("last_embed_at"))
    took = pipeline.seconds(F.col("transcribe_finished_at"), F.col("transcribe_started_at"))
    of_metrics = metrics.agg(F.avg(took).alias("avg_processing_seconds"), F.sum(F.when(F.col("embed_finished_at").isNotNull(), F.col("embed_total_tokens"))).alias("total_embed_tokens"), F.sum("word_count").alias("total_words"))

    judged = metrics.where("eval_finished_at is not null").select(F.col("job_id").alias("id")).distinct()
    has_chunks = transcripts.select(F.col("id").alias("transcript_id"), "job_id").join(chunks.select("transcript_id").distinct(), "transcript_id", "left_semi").select(F.col("job_id").alias("id")).distinct()
    buckets = pipeline.pipeline_buckets(jobs, judged, has_chunks).select("transcribed", "evaluated", "embedded")
    # every transcript without chunks is to be embedded; of those, the done and unjudged ones are to be judged
    left = transcripts.select("id", "job_id").join(chunks.select(F.col("transcript_id").alias("id")), "id", "left_anti")
    open_ = jobs.where("status = 'done'").join(judged, "id", "left_anti").select(F.col("id").alias("job_id"), F.lit(True).alias("_open"))
    backlog = left.join(open_, "job_id", "left").agg(F.count("*").alias("embed_backlog"), F.count_if(F.col("_open")).alias("eval_backlog"))
    covered = jobs.where("status = 'done'").join(judged, "id", "left_semi").agg(F.count("*").alias("eval_coverage_done"))
    books = jobs.groupBy(book_dir(F.col("file_path")).alias("d")).agg(F.count_if(F.col("status") != "done").alias("open")).agg(F.count("*").alias("books_total"), F.count_if(F.col("open") == 0).alias("books_fully_done"))
    last = log.where(F.col("stage") == stage).agg(F.max_by(F.coalesce(F.get_json_object("detail", "$.reason"), "reason"), "created_at").alias("_reason"))
    last = last.select(F.col("_reason").isNotNull().alias("runner_available_known"), F.coalesce(F.col("_reason") == idle, F.lit(False)).alias("runner_available"))
    settings = control.limit(1).groupBy().agg(F.coalesce(F.max("paused"), F.lit(False)).alias("paused"), F.max("run_limit").alias("run_limit"), F.coalesce(F.max("phase"), F.lit("idle")).alias("phase"))
    out = by_job
    for part in (of_transcripts, of_chunks, of_metrics, buckets, backlog, covered, books, last, settings):
        out = out.crossJoin(part)  # a row each
    return out


def status_json(snap: DataFrame, evaluates: bool = True, forecast: DataFrame | None = None, servers: DataFrame | None = None) -> DataFrame:
    """The snapshot with the lifecycle as one JSON object, and with the forecast (a row) and the servers (a row a machine:
    server, state, detail, jobs and others), by name, where they are given."""
    stats = snap.select(
        "*", F.lit(evaluates).alias("evaluates"), F.lit(False).alias("probed"), F.lit(False).alias("probe_active"),
    ).withColumn("_bucket", F.col("evaluated")).withColumn("evaluated", F.col("eval_coverage_done"))
    cycle = status.lifecycle(stats)
    queue = F.struct("pending", "claimed", "done", "failed", "total_jobs", "done_last_hour")
    life = F.struct("phase", "activity", F.round("coverage", 6).alias("coverage"), "fully_done", "committed", "embed_backlog", "eval_backlog")
    stages = F.struct("transcribed", F.col("_bucket").alias("evaluated"), "embedded")
    parts = [queue.alias("queue"), life.alias("lifecycle"), stages.alias("stages"), F.struct("books_total", "books_fully_done", "total_words").alias("library")]
    if forecast is not None:
        cycle = cycle.crossJoin(forecast.select(F.struct("chunks", "work", "calendar", F.col("calendar").isNotNull().alias("calendar_known"), "evaluated", "has_work").alias("_eta")))  # a row
        parts.append(F.col("_eta").alias("eta"))
    if servers is not None:
        machines = servers.agg(F.sort_array(F.collect_list(F.struct("server", *[c for c in servers.columns if c != "server"]))).alias("_servers"))
        cycle = cycle.crossJoin(machines)  # a row
        parts.append(F.col("_servers").alias("servers"))
    return cycle.select(F.to_json(F.struct(*parts)).alias("status"))


def feeds(jobs: DataFrame, metrics: DataFrame, meta: DataFrame) -> DataFrame:
    """The books of the queue feed and, of those that aren't in it, of the activity feed, each with its tracks: (feed,
    place, book_dir, title, author, counts, done_pct, tracks). All tracks come with one join."""
    rows = library.book_rollup(jobs, metrics).select("book_dir", "total", "done", "pending", "claimed", "failed", "last_updated")
    orders = library._sorts()
    queue = rows.where("pending > 0 or claimed > 0").orderBy(*orders["queue"]).limit(QUEUE_ROWS)
    queue = queue.select(F.lit("queue").alias("feed"), "*")
    recent = rows.orderBy(*orders["activity"]).limit(ACTIVITY_ROWS).select(F.lit("activity").alias("feed"), "*")
    recent = recent.join(F.broadcast(queue.select("book_dir")), "book_dir", "left_anti").select(queue.columns)  # at most twenty rows
    books = queue.unionByName(recent)
    named = jobs.withColumn("book_dir", book_dir(F.col("file_path"))).join(F.broadcast(books.select("book_dir").distinct()), "book_dir", "left_semi")
    track = F.struct("file_path", "id", "status", "updated_at")
    tracks = named.groupBy("book_dir").agg(F.sort_array(F.collect_list(track)).alias("tracks"))
    out = books.join(tracks, "book_dir", "left").join(meta.select("book_dir", "title", "author"), "book_dir", "left")
    return out.withColumn("done_pct", F.when(F.col("total") > 0, F.floor(F.col("done") * 100 / F.col("total"))).otherwise(0).cast("int"))


def book_page(tracks: DataFrame) -> DataFrame:
    """One row of counts of a book's tracks (status, embed_chunk_count), embedding over done ones only."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    done = F.col("status") == "done"
    return tracks.agg(
        F.count("*").alias("total"), n("pending"), n("claimed"), n("done"), n("failed"), F.count_if(done).alias("embed_total"), F.count_if(done & F.col("embed_chunk_count").isNotNull()).alias("embed_done")
    )


def segment_at(segments: Column, t: Column) -> Column:
    """The index of the first segment that ends at t or later, else of the last; 0 before the start or without any."""
    ends = F.transform(segments, lambda s, i: F.struct(s["end"].alias("end"), i.alias("i")))
    first = F.get(F.filter(ends, lambda s: s["end"] >= t), F.lit(0))["i"]
    return F.when((F.size(segments) <= 0) | (t <= 0), 0).otherwise(F.coalesce(first, F.size(segments) - 1)).cast("int")


def track_page(transcripts: DataFrame, t: Column, size: int) -> DataFrame:
    """transcripts (id, segments) with the index of the segment at t, its page and that page's segments."""
    at = transcripts.withColumn("segment", segment_at(F.col("segments"), t)).withColumn("page", F.floor(F.col("segment") / size).cast("int"))
    return at.withColumn("segments", F.slice("segments", F.col("page") * size + 1, F.lit(size)))


def by_family(servers: DataFrame) -> DataFrame:
    """(family, place, servers): servers (position, name, family) by model family, in the order of first sight."""
    key = F.coalesce("family", F.lit(""))
    by = servers.groupBy(key.alias("family")).agg(F.min("position").alias("first"), F.sort_array(F.collect_list(F.struct("position", "name"))).alias("s"))
    return by.select(F.when(F.col("family") == "", "unknown").otherwise(F.col("family")).alias("family"), "first", F.transform("s", lambda x: x["name"]).alias("servers"))


def candidates_for(books: DataFrame, named: str) -> DataFrame:
    """Books (book_dir, author, title) that a free text may mean: by a catalogue number in square brackets exactly, else
    those whose author and title, without such numbers, hold the text."""
    number = books.sparkSession.range(1).select(asin(F.lit(named)).alias("n")).first().n
    blank = lambda c: F.coalesce(c, F.lit(""))
    if number:
        return books.where(F.upper(F.coalesce(asin(blank("title")), asin(F.col("book_dir")), F.lit(""))) == number)
    label = F.trim(F.concat(without_asin(blank("author")), F.lit(" "), without_asin(blank("title"))))
    return books.where(contains_exact(label, named))


def resolve_book(books: DataFrame, named: str) -> str:
    """The directory of the one book that is meant; an error that lists the candidates if it is none or several."""
    found = candidates_for(books, named).orderBy("book_dir").limit(CANDIDATES).collect()
    if len(found) == 1:
        return found[0].book_dir
    if not found:
        raise LookupError(f"no book matches {named!r}")
    listed = "\n".join(f"  {' — '.join(x for x in (r.author, r.title) if x)} ({r.book_dir})" for r in found)
    raise LookupError(f"{named!r} matches {len(found)} books:\n{listed}")


def search_context(hits: DataFrame, tracks: DataFrame, books: DataFrame) -> DataFrame:
    """hits (file_path, start_sec, similarity, text) with what their books tell: title, author, series, chapter (index,
    title and number of chapters), the time in the book, and the file's checksum.

    tracks: file_path, duration_seconds, checksum; books: book_dir, title, author, series, chapters (index, start_sec,
    end_sec, title; times in the book). Only the tracks of the hits' books are summed up."""
    at = hits.withColumn("book_dir", book_dir(F.col("file_path")))
    dirs = at.select("book_dir").distinct()
    own = tracks.withColumn("_dir", book_dir(F.col("file_path"))).join(dirs, F.col("_dir") == F.col("book_dir"), "left_semi")
    placed = library.track_offsets(own, "_dir", "file_path", "duration_seconds").select(F.col("file_path").alias("_path"), "offset", "checksum")
    out = at.join(placed, F.col("file_path") == F.col("_path"), "left").join(books, "book_dir", "left").drop("_path")
    second = F.col("offset") + F.col("start_sec")
    out = out.withColumn("book_sec", second).withColumn("_c", library.chapter_at(F.col("chapters"), second))
    out = out.withColumn("chapter_index", F.col("_c.index")).withColumn("chapter_title", F.col("_c.title")).withColumn("total_chapters", F.coalesce(F.size(F.nullif("chapters", F.array())), F.lit(0)))
    return out.withColumn("percent", (F.col("similarity") * 100).cast("int")).drop("_c", "chapters", "offset")


def track_detail(jobs: DataFrame, transcripts: DataFrame, metrics: DataFrame, chunks: DataFrame, job_id) -> DataFrame:
    """One row, if there is such a job: its columns, has_transcript with the transcript's and the run's columns, the
    seconds it took, and its chunks in order (chunk_index, start_sec, end_sec, speaker, chars, stale).

    jobs (id, ...), transcripts (id, job_id, ...), metrics (job_id, transcribe_started_at, transcribe_finished_at, ...),
    chunks (transcript_id, chunk_index, start_sec, end_sec, speaker, text, embedding_stale). Every table is narrowed to
    the job before it is joined, and the id reaches the readers of three of them."""
    job = jobs.where(F.col("id") == job_id)
    t = transcripts.where(F.col("job_id") == job_id).select(F.col("id").alias("transcript_id"), *[c for c in transcripts.columns if c not in ("id", *jobs.columns)])
    m = metrics.where(F.col("job_id") == job_id)
    took = pipeline.seconds(F.col("transcribe_finished_at"), F.col("transcribe_started_at"))
    m = m.withColumn("processing_seconds", took).select("job_id", *[c for c in [*metrics.columns, "processing_seconds"] if c not in (*jobs.columns, *t.columns)])
    row = F.struct("chunk_index", "start_sec", "end_sec", "speaker", F.char_length("text").alias("chars"), F.col("embedding_stale").alias("stale"))
    own = chunks.join(F.broadcast(t.select("transcript_id").distinct()), "transcript_id", "left_semi")  # a transcript a job
    lists = own.groupBy("transcript_id").agg(F.sort_array(F.collect_list(row)).alias("chunks"))
    told = t.join(lists, "transcript_id", "left").withColumn("has_transcript", F.lit(True))
    out = job.join(told, F.col("id") == F.col("job_id"), "left").drop("job_id").join(m, F.col("id") == F.col("job_id"), "left").drop("job_id")
    return out.withColumn("has_transcript", F.coalesce("has_transcript", F.lit(False))).withColumn("chunks", F.coalesce("chunks", F.array().cast(dict(lists.dtypes)["chunks"])))
