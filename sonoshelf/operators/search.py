"""Vector and text search over chunks: filter first, rank, cut to the limit, then enrich the few rows left."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoshelf.functions.text import TRIGRAM_THRESHOLD, contains_wild, trigrams, word_count

from .vector import cosine_to

MOST_ROWS, DEFAULT_LIMIT, DEFAULT_THRESHOLD = 1000, 10, 0.3


def clamp_limit(n: int | None, default: int = DEFAULT_LIMIT) -> int:
    return n if n is not None and 1 <= n <= MOST_ROWS else default


def similar(chunks: DataFrame, query: list[float], *, limit: int | None = None, threshold: float | None = None, scope: Column | None = None, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """The rows nearest to query by cosine, with similarity. A scope narrows the rows before any distance is taken; no
    threshold, or 0, keeps all."""
    rows = chunks if scope is None else chunks.where(scope)
    rows = rows.withColumn("similarity", cosine_to(vector, query)).where("similarity is not null")
    if threshold:
        rows = rows.where(F.col("similarity") >= threshold)
    return rows.orderBy(F.desc("similarity"), id_col).limit(clamp_limit(limit))


def query_trigrams(spark: SparkSession, query: str) -> list[str]:
    """The trigrams of a query, once and not for each row."""
    return spark.range(1).select(trigrams(F.lit(query)).alias("t")).first().t


def similarity_to(text: Column, asked: list[str]) -> Column:
    """Trigram similarity of a text to the query with these trigrams."""
    if not asked:
        return F.lit(0.0)

    def similarity(x: Column) -> Column:
        both = F.size(F.array_intersect(x, F.array(*map(F.lit, asked))))
        return both / (F.size(x) + len(asked) - both)

    return F.transform(F.array(trigrams(text)), similarity)[0]  # binds the text's trigrams, so they are made once


def by_text(chunks: DataFrame, query: str, *, limit: int | None = None, scope: Column | None = None, id_col: str = "id", order: str = "chunk_index", text: str = "text") -> DataFrame:
    """The rows that are like the query by trigrams or hold it, most similar first. Wildcards in the query work."""
    rows = chunks if scope is None else chunks.where(scope)
    rows = rows.withColumn("similarity", similarity_to(F.col(text), query_trigrams(rows.sparkSession, query)))
    return rows.where((F.col("similarity") >= TRIGRAM_THRESHOLD) | contains_wild(F.col(text), query)).orderBy(F.desc("similarity"), order, id_col).limit(clamp_limit(limit))


def neighbours(chunks: DataFrame, of: DataFrame, n: int, group: str, index: str) -> DataFrame:
    """The chunks at most n places from those of ``of`` (group, index) in their transcript; gaps in the index count."""
    at = of.select(F.col(group).alias("_group"), F.col(index).alias("_index"))
    n = min(max(n, 0), 50)
    near = F.col(index).between(F.greatest(F.lit(0), F.col("_index") - n), F.col("_index") + n)
    return chunks.join(at, (F.col(group) == F.col("_group")) & near).drop("_group", "_index")


def with_totals(hits: DataFrame, chunks: DataFrame, group: str) -> DataFrame:
    """hits with total_chunks, the number of chunks of each one's transcript; chunks are counted before they are joined."""
    counts = chunks.groupBy(group).agg(F.count("*").alias("total_chunks"))
    return hits.join(counts, group, "left")


def trigram_index(chunks: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """(trigram, id, n): an inverted index; write it partitioned or bucketed by trigram."""
    return chunks.select(F.col(id_col).alias("id"), trigrams(F.col(text)).alias("t")).select(F.explode("t").alias("trigram"), "id", F.size("t").alias("n"))


def by_index(index: DataFrame, query: str, threshold: float = TRIGRAM_THRESHOLD) -> DataFrame:
    """(id, similarity) of the texts in a trigram index that are like the query, reading its trigrams' rows only."""
    asked = query_trigrams(index.sparkSession, query)
    if not asked:
        return index.select("id", F.lit(0.0).alias("similarity")).where("false")
    shared = index.where(F.col("trigram").isin(asked)).groupBy("id").agg(F.count("*").alias("both"), F.first("n").alias("n"))
    return shared.select("id", (F.col("both") / (F.col("n") + len(asked) - F.col("both"))).alias("similarity")).where(F.col("similarity") >= threshold)


def hyperplanes(dims: int, bits: int, seed: int = 7) -> list[list[float]]:
    return np.random.default_rng(seed).normal(size=(bits, dims)).round(6).tolist()


def bucket_of(vector: Column, planes: list[list[float]]) -> Column:
    """The side of each hyperplane that a vector is on, as bits: near vectors share most."""
    rows = F.expr(f"array({', '.join('array(' + ', '.join(f'{x!r}D' for x in p) + ')' for p in planes)})")  # one literal, parsed at once
    sides = F.transform(rows, lambda p: F.aggregate(F.zip_with(vector, p, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x) >= 0)
    return F.aggregate(F.reverse(sides), F.lit(0), lambda a, x: a * 2 + F.when(x, 1).otherwise(0))


def near_by_buckets(chunks: DataFrame, query: list[float], *, bits: int = 8, flips: int = 2, tables: int = 8, limit: int | None = None, scope: Column | None = None, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """Approximate search: rows whose bucket differs from the query's in at most flips bits in any of the tables, each
    with hyperplanes of its own, ranked exactly. The scope comes first, so it costs no recall; with bucket columns that
    """
    planes, near = hyperplanes(len(query), bits * tables), F.lit(False)
    for t in range(tables):
        own = planes[t * bits : (t + 1) * bits]
        mine = sum(1 << k for k, p in enumerate(own) if float(np.dot(p, query)) >= 0)
        near |= F.bit_count(bucket_of(F.col(vector), own).bitwiseXOR(F.lit(mine))) <= flips
    rows = chunks if scope is None else chunks.where(scope)
    return similar(rows.where(near), query, limit=limit, id_col=id_col, vector=vector)


def enriched(hits: DataFrame, books: DataFrame, book: str = "book_dir", text: str = "text") -> DataFrame:
    """hits with title, author, percent (cut, not rounded) and the word count of the whole text."""
    context = hits.select(book).distinct()
    meta = books.join(context, book, "left_semi")
    return hits.join(meta, book, "left").withColumn("percent", (F.col("similarity") * 100).cast("int")).withColumn("words", word_count(F.col(text)))
