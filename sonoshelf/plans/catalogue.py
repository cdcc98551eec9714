"""All queries on the given tables, with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    """WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]), 5) AS similarity
    FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]) DESC, vec_id LIMIT 10"""
)
def vector_topk(spark, sf_dir):
    from sonoshelf.operators.vector import cosine_to, vector_of

    v = table(spark, sf_dir, "embeddings")
    near = v.withColumn("s", cosine_to("embedding", vector_of(v, "vec_id", 0)))
    return near.orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", "label", F.round("s", 5).alias("similarity"))
