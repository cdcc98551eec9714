"""A stored trigram index for text search, with the results of search.by_text.

``rows`` has a row per distinct trigram of a text (trigram, id, and n, how many the text has) in directories by the
trigram's hash, sorted by trigram; ``counts`` has how many texts hold each. A search reads the directories of its own
trigrams only:

* A text that is as similar as the threshold t shares t * m of the query's m trigrams, so it holds one of the rarest
  m - ceil(t * m) + 1 of them (prefix filter), and has between t * m and m / t trigrams itself (length filter).
* A text that holds the query has every trigram that surely lies inside a word of it; the rarest of those gives the
  candidates, which are then looked at as they are. A query without such trigrams has the texts scanned for it.

Similarity is then counted from the index, for the candidates only. A trigram of very many texts is dealt over several
files by the texts' ids.
"""

from __future__ import annotations

import math
import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoshelf.functions.text import TRIGRAM_THRESHOLD, contains_wild, trigrams

from .search import clamp_limit, query_trigrams

BUCKETS, SALTS = 64, 4
#: So many candidates are looked up in the texts by their ids, which reach the reader; more of them by a join.
PUSHED_IDS = 2000


def bucket_of(trigram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(buckets)).cast("int")


def build(chunks: DataFrame, path: str, *, id_col: str = "id", text: str = "text", buckets: int = BUCKETS) -> None:
    """Write the index of chunks (id, text) to path. Texts without trigrams have no rows."""
    told = chunks.select(F.col(id_col).alias("id"), trigrams(F.col(text)).alias("t")).select(F.explode("t").alias("trigram"), "id", F.size("t").alias("n"))
    rows = told.withColumn("bucket", bucket_of(F.col("trigram"), buckets))
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(SALTS))).sortWithinPartitions("bucket", "trigram", "id")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")
    spark = chunks.sparkSession
    counts = _read(spark, f"{path}/rows", "trigram string, bucket int").groupBy("bucket", "trigram").agg(F.count("*").alias("texts"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "trigram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/counts")
    spark.createDataFrame([(buckets, dict(rows.dtypes)["id"])], "buckets int, id string").coalesce(1).write.mode("overwrite").json(f"{path}/made")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _letter(c: str) -> bool:
    kind = unicodedata.category(c)
    return kind[0] == "L" or kind == "Nd"


def sure_trigrams(query: str) -> set[str]:
    """Trigrams of any text that LIKE finds for %query%, in lower case. Beside a wildcard and at the ends of the query a
    word may go on; a query with backslashes, which escape, has none."""
    if "\\" in query:
        return set()
    out = set()
    for piece in re.split("[%_]", query.lower()):
        words, start = [], None
        for k, c in enumerate(piece + " "):
            inside = k < len(piece) and _letter(c)
            if inside and start is None:
                start = k
            elif not inside and start is not None:
                words.append((start, k))
                start = None
        for a, b in words:
            padded = ("  " if a > 0 else "") + piece[a:b] + (" " if b < len(piece) else "")
            out |= {padded[i : i + 3] for i in range(len(padded) - 2)}
    return out


class TextIndex:
    """The index at path, for searches."""

    def __init__(self, spark: SparkSession, path: str):
        made = spark.read.schema("buckets int, id string").json(f"{path}/made").first()
        self.spark, self.buckets = spark, made.buckets
        self.rows = _read(spark, f"{path}/rows", f"trigram string, id {made.id}, n int, bucket int")
        self.counts = _read(spark, f"{path}/counts", "trigram string, texts long, bucket int")

    def of(self, table: DataFrame, asked: list[str]) -> DataFrame:
        """The table's rows of these trigrams, from their buckets."""
        told = self.spark.createDataFrame([(t,) for t in asked], "t string").select(bucket_of(F.col("t"), self.buckets).alias("b")).distinct().collect()  # a row a trigram at most
        return table.where(F.col("bucket").isin([r.b for r in told]) & F.col("trigram").isin(asked))

    def by_rarity(self, asked: list[str]) -> list[str]:
        """These trigrams, those of the fewest texts first; a row a trigram comes back."""
        texts = {r.trigram: r.texts for r in self.of(self.counts, asked).collect()}
        return sorted(asked, key=lambda t: (texts.get(t, 0), t))

    def like(self, asked: list[str], threshold: float) -> DataFrame:
        """Ids of the texts that may be similar to the query with these trigrams."""
        least = math.ceil(round(threshold * len(asked), 9))
        prefix = self.by_rarity(asked)[: len(asked) - least + 1]
        rows = self.of(self.rows, prefix).where(F.col("n").between(least, math.floor(round(len(asked) / threshold, 9))))
        return rows.select("id").distinct()

    def holding(self, query: str) -> DataFrame | None:
        """Ids of the texts that may hold the query; None if the index can't tell."""
        sure = sorted(sure_trigrams(query))
        return self.of(self.rows, self.by_rarity(sure)[:1]).select("id") if sure else None

    def similarity(self, ids: DataFrame, asked: list[str]) -> DataFrame:
        """(id, similarity) of these texts; those that share nothing have no row."""
        rows = self.of(self.rows, asked).join(ids, "id", "left_semi")
        shared = rows.groupBy("id").agg(F.count("*").alias("both"), F.first("n").alias("n"))
        return shared.select("id", (F.col("both") / (F.col("n") + len(asked) - F.col("both"))).alias("similarity"))


def by_index(index: TextIndex, chunks: DataFrame, query: str, *, threshold: float = TRIGRAM_THRESHOLD, limit: int | None = None, id_col: str = "id", order: str = "chunk_index", text: str = "text") -> DataFrame:
    """The rows of chunks that are like the query by trigrams or hold it, as search.by_text has them. id_col must be
    without repeats or nulls."""
    asked = query_trigrams(index.spark, query)
    own = chunks.withColumn("_id", F.col(id_col))
    may = index.holding(query)
    held = own if may is None else picked(own, may)
    held = held.where(contains_wild(F.col(text), query)).select("_id")
    if asked and threshold > 0:
        similar = index.similarity(index.like(asked, threshold), asked).where(F.col("similarity") >= threshold)
        told = similar.unionByName(index.similarity(held.select(F.col("_id").alias("id")), asked))
        told = told.unionByName(held.select(F.col("_id").alias("id"), F.lit(0.0).alias("similarity"))).groupBy("id").agg(F.max("similarity").alias("similarity"))
    else:
        told = held.select(F.col("_id").alias("id"), F.lit(0.0).alias("similarity"))
    out = own.join(told.withColumnRenamed("id", "_of"), F.col("_id") == F.col("_of"))
    return out.orderBy(F.desc("similarity"), order, id_col).limit(clamp_limit(limit)).drop("_id", "_of")


def picked(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks with these ids: few ids are pushed to the reader, many are joined."""
    few = ids.limit(PUSHED_IDS + 1).collect()
    if len(few) <= PUSHED_IDS:
        return chunks.where(F.col("_id").isin([r.id for r in few])) if few else chunks.where("false")
    return chunks.join(ids.withColumnRenamed("id", "_may"), F.col("_id") == F.col("_may"), "left_semi")
