"""Rollups of tracks to books, series and the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoshelf.functions.text import book_dir, contains_wild, sequence_order, series_refs

SORTS: dict[str, list[Column]] = {}


def _sorts() -> dict[str, list[Column]]:
    done, dir_ = F.col("done"), F.col("book_dir").asc()
    return {
        "default": [(done / F.nullif(F.col("total"), F.lit(0))).desc_nulls_last(), done.desc(), F.col("last_updated").desc_nulls_last(), dir_],
        "activity": [F.col("last_updated").desc_nulls_last(), dir_],
        "queue": [(F.col("claimed") > 0).desc(), F.col("claimed").desc(), F.col("pending").desc(), F.col("last_updated").asc_nulls_first(), dir_],
    }


def book_rollup(jobs: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per book: tracks by status, time, words and last change. Metrics are one row a job at most."""
    tracks = jobs.withColumn("book_dir", book_dir(F.col("file_path"))).join(metrics, F.col("id") == F.col("job_id"), "left")
    by = [F.count_if(F.col("status") == s).alias(s) for s in ("done", "pending", "claimed", "failed")]
    return tracks.groupBy("book_dir").agg(F.count("*").alias("total"), *by, F.sum("duration_seconds").alias("duration_seconds"), F.sum("word_count").alias("words"), F.max("updated_at").alias("last_updated"))


def book_summaries(
    jobs: DataFrame, metrics: DataFrame, meta: DataFrame, *, status: str | None = None, series: str | None = None, query: str | None = None, sort: str = "default", limit: int = 20, offset: int = 0
) -> DataFrame:
    """A page of books with the number of all that match beside each row (an offset past the end gives no rows).

    status keeps books that have such a track, or "complete" those with all tracks done. Books are grouped before
    they meet their metadata, and the total is a one-row join instead of a window over everything.
    """
    if sort not in (orders := _sorts()):
        raise ValueError(f"unknown sort {sort!r}")
    if status not in (None, "complete", "done", "pending", "claimed", "failed"):
        raise ValueError(f"unknown status {status!r}")
    rows = book_rollup(jobs, metrics)
    if status == "complete":
        rows = rows.where("total > 0 and done = total")
    elif status:
        rows = rows.where(F.col(status) > 0)
    rows = rows.join(meta, "book_dir", "left")
    if series:
        rows = rows.where(contains_wild(F.col("series"), series))
    if query:
        rows = rows.where(contains_wild(F.col("book_dir"), query) | contains_wild(F.coalesce("title", F.lit("")), query) | contains_wild(F.coalesce("author", F.lit("")), query))
    page = rows.orderBy(*orders[sort]).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(rows.agg(F.count("*").alias("matching"))))


def library_totals(jobs: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: books, complete books, books with failures, tracks, time and words."""
    return book_rollup(jobs, metrics).agg(
        F.count("*").alias("books"), F.count_if(F.col("total") == F.col("done")).alias("complete"), F.count_if(F.col("failed") > 0).alias("with_failures"),
        F.sum("total").alias("tracks"), F.sum("done").alias("done"), F.sum("duration_seconds").alias("duration_seconds"), F.sum("words").alias("words"),
    )


def book_tracks(jobs: DataFrame, metrics: DataFrame, directory: str) -> DataFrame:
    """The tracks of one book in order."""
    # the prefix reaches the Parquet reader, which the pattern can't
    tracks = jobs.where(F.col("file_path").startswith(directory + "/") & (book_dir(F.col("file_path")) == directory))
    return tracks.join(metrics, F.col("id") == F.col("job_id"), "left").orderBy("file_path")


def series_members(books: DataFrame) -> DataFrame:
    """(name, sequence, book_dir, place): a book in each of its series, books without one under "No series", by sequence."""
    refs = books.select("book_dir", F.explode_outer(series_refs(F.col("series"))).alias("r"))
    rows = refs.select(F.coalesce("r.name", F.lit("No series")).alias("name"), F.coalesce("r.sequence", F.lit("")).alias("sequence"), "book_dir")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy(*sequence_order(F.col("sequence")), "book_dir")))


def track_offsets(tracks: DataFrame, book: str, order: str, duration: str) -> DataFrame:
    """tracks with offset: the time of all tracks before it in its book, null if one of those isn't a positive number."""
    before = Window.partitionBy(book).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = F.col(duration).cast("double")
    good = F.coalesce((d > 0) & ~F.isnan(d) & (d < float("inf")), F.lit(False))
    return tracks.withColumn("offset", F.when(F.coalesce(F.min(good.cast("int")).over(before), F.lit(1)) == 1, F.coalesce(F.sum(F.when(good, d)).over(before), F.lit(0.0))))


def chapter_at(chapters: Column, t: Column) -> Column:
    """The last chapter, by position, that starts at or before t; null after its end, unless that is 0 for open."""
    last = F.try_element_at(F.filter(chapters, lambda c: c["start_sec"] <= t), F.lit(-1))
    within = (last["end_sec"] == 0) | (t <= last["end_sec"] + 0.001)
    return F.when((F.size(F.filter(chapters, lambda c: c["start_sec"] <= t)) > 0) & within, last)


def page_of(segments: Column, offset: int, count: int) -> Column:
    """A page of an array."""
    return F.slice(segments, offset + 1, count)


def by_author(books: DataFrame) -> DataFrame:
    """(author, first, books): books (position, book_dir, title, author) by author, in the order of first sight."""
    by = books.groupBy("author").agg(F.min("position").alias("first"), F.sort_array(F.collect_list(F.struct("position", "book_dir", "title"))).alias("b"))
    return by.select("author", "first", F.transform("b", lambda x: x["book_dir"]).alias("books"))


def library_sort(sort: str) -> list[Column]:
    """Keys of a library page (book_dir, title, author, done, total, findings, last_updated) by title, progress,
    findings or, else, the latest change."""
    label = F.lower(F.trim(F.concat(F.coalesce("author", F.lit("")), F.lit(" "), F.coalesce("title", F.lit("")))))
    keys = {"title": [F.when(label == "", F.lower("book_dir")).otherwise(label).asc()], "progress": [(F.col("done") / F.nullif(F.col("total"), F.lit(0))).desc_nulls_last()], "findings": [F.desc("findings")]}
    return [*keys.get(sort, []), F.col("last_updated").desc_nulls_last(), F.col("book_dir").asc()]
