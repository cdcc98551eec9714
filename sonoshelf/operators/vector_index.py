"""A stored index for approximate vector search: inverted lists of quantised vectors.

Centroids come from k-means over a bounded sample; every row is written to the list of its nearest centroid, a
directory of Parquet files, with its vector and a code of four bits a component. A search reads the codes of the lists
next to each query only (partition pruning), ranks them by code, and takes the exact similarity of a short list, whose
vectors it reads by list and id. So of each list that is looked into it reads an eighth of the vectors' bytes, and whole
vectors of a few rows.

Rows are dealt by list and a salt, so one list that holds a third of all rows is written by several tasks. Centroids
and queries come to the driver, both of a bounded number. Rows whose vector is null, has another length than the
first of the sample, holds null or non-finite components or is zero have no cosine and aren't indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vector import dot, norm

SAMPLE_ROWS, MOST_LISTS, MOST_QUERIES = 20_000, 4096, 4096
SALTS, CODE_TOP = 8, 7
#: The share of the lists that a search looks into, and how many rows a query ranks exactly for each it returns.
PROBED, SHORT = 0.6, 5


def usable(vector: Column) -> Column:
    """Vectors that have a cosine."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # NaN is above infinity
    return F.coalesce(finite & (norm(vector) > 0), F.lit(False))


def fitted_centroids(vectors: DataFrame, id_col: str, vector: str, lists: int | None, sample_rows: int, seed: int) -> np.ndarray:
    """Unit centroids of k-means over the sample_rows rows with the smallest hashes; by default as many as the root of
    the number of rows."""
    n = vectors.count()
    k = min(MOST_LISTS, max(1, lists or round(n**0.5)), max(1, n))
    sample = vectors.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(sample_rows)
    size = norm(F.col(vector))
    unit = sample.select(array_to_vector(F.transform(vector, lambda x: x.cast("double") / size)).alias("features"))
    model = KMeans(k=max(2, k), seed=seed, maxIter=12, distanceMeasure="euclidean").fit(unit)
    c = np.array(model.clusterCenters())
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def codes_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows as integers from -7 to 7, two a byte, and what to multiply them by."""
    step = np.abs(x).max(1) / CODE_TOP
    q = (np.rint(x / step[:, None]) + CODE_TOP).astype(np.uint8)
    if q.shape[1] % 2:
        q = np.pad(q, ((0, 0), (0, 1)), constant_values=CODE_TOP)
    return q[:, ::2] | q[:, 1::2] << 4, step


def from_codes(codes: np.ndarray, step: np.ndarray, dims: int) -> np.ndarray:
    q = np.stack([codes & 15, codes >> 4], axis=2).reshape(len(codes), -1)[:, :dims]
    return (q.astype(np.float32) - CODE_TOP) * step[:, None].astype(np.float32)


def build(vectors: DataFrame, path: str, *, id_col: str = "id", vector: str = "embedding", lists: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> None:
    """Write the index of vectors (id, vector) to path: rows by list, and centroids."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("vector")).where(usable(F.col("vector")))
    first = rows.select(F.size("vector")).first()
    dims = first[0] if first else 0
    rows = rows.where(F.size("vector") == dims)
    centroids = fitted_centroids(rows, "id", "vector", lists, sample_rows, seed) if dims else np.empty((0, 0))
    kinds = dict(rows.dtypes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vector"), dims)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            codes, step = codes_of(x)
            data = [pa.array((x @ centroids.T).argmax(1).astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(step)]
            yield pa.RecordBatch.from_arrays([*data, b.column("id"), b.column("vector")], ["list", "code", "step", "id", "vector"])

    schema = f"list int, code binary, step double, id {kinds['id']}, vector {kinds['vector']}"
    placed = rows.mapInArrow(place, schema) if dims else spark.createDataFrame([], schema)
    dealt = placed.repartition("list", F.pmod(F.xxhash64("id"), F.lit(SALTS))).sortWithinPartitions("list", "id")
    dealt.write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    told = [(k, c.tolist()) for k, c in enumerate(centroids)]
    spark.createDataFrame(told, "list int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    rows.limit(0).select("id", "vector").coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")


def index_rows(spark: SparkSession, path: str) -> DataFrame:
    """(list, code, step, id, vector) of the index at path."""
    kinds = dict(spark.read.parquet(f"{path}/schema").dtypes)
    return spark.read.schema(f"code binary, step double, id {kinds['id']}, vector {kinds['vector']}, list int").parquet(f"{path}/rows")


def nearest_lists(queries: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    return np.argsort(-(queries @ centroids.T), axis=1, kind="stable")[:, :probes]


class Search:
    """A search for the limit nearest rows of each query (query_id, vector), at most MOST_QUERIES of them. Queries without
    a cosine, or of another length than the index, have no hits.

    ``short_list`` reads codes of the probed lists only, and ``hits`` the vectors of the short list."""

    def __init__(self, spark: SparkSession, path: str, queries: DataFrame, *, limit: int = 10, probes: int | None = None, short: int = SHORT):
        self.rows, self.limit, self.keep = index_rows(spark, path), limit, limit * short
        asked = queries.where(usable(F.col("vector"))).limit(MOST_QUERIES + 1).collect()
        if len(asked) > MOST_QUERIES:
            raise ValueError(f"at most {MOST_QUERIES} queries at a time")
        centroids = np.array([r.centroid for r in spark.read.parquet(f"{path}/centroids").orderBy("list").collect()])
        asked = [r for r in asked if len(centroids) and len(r.vector) == centroids.shape[1]]
        self.ids = [r.query_id for r in asked]
        self.queries = np.array([r.vector for r in asked], float)
        self.kind = dict(queries.dtypes)["query_id"]
        if not asked:
            self.rows, self.lists, self.probed = self.rows.where("false"), np.empty((0, 0), int), []
            return
        self.queries /= np.linalg.norm(self.queries, axis=1, keepdims=True)
        self.lists = nearest_lists(self.queries, centroids, probes or max(1, round(PROBED * len(centroids))))
        self.probed = sorted(set(self.lists.ravel().tolist()))
        self.rows = self.rows.where(F.col("list").isin(self.probed))

    def short_list(self) -> DataFrame:
        """(q, list, id): the rows with the best codes for each query, by its number."""
        queries, keep = self.queries.astype(np.float32), self.keep
        asking: dict[int, list[int]] = {}
        for q, lists in enumerate(self.lists.tolist()):
            for li in lists:
                asking.setdefault(li, []).append(q)
        at = {li: np.array(qs) for li, qs in asking.items()}

        def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = b.column("list").to_numpy()
                raw = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                x = from_codes(raw, b.column("step").to_numpy(), queries.shape[1])
                q, r, s = [], [], []
                for li in np.unique(lists).tolist():
                    mine = np.flatnonzero(lists == li)
                    scores = queries[at[li]] @ x[mine].T
                    top = np.argsort(-scores, axis=1, kind="stable")[:, :keep]
                    q.append(np.repeat(at[li], top.shape[1]))
                    r.append(mine[top.ravel()])
                    s.append(np.take_along_axis(scores, top, 1).ravel())
                if q:
                    r = np.concatenate(r)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(q).astype(np.int32)), b.column("list").take(pa.array(r)), b.column("id").take(pa.array(r)), pa.array(np.concatenate(s).astype(np.float64))], ["q", "list", "id", "approximate"])

        found = self.rows.select("list", "code", "step", "id").mapInArrow(rank, f"q int, list int, id {dict(self.rows.dtypes)['id']}, approximate double")
        w = Window.partitionBy("q").orderBy(F.desc("approximate"), "id")
        return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep).select("q", "list", "id")

    def hits(self) -> DataFrame:
        """(query_id, rank, id, similarity): the exact cosine of the short list's best."""
        spark = self.rows.sparkSession
        # as many rows as queries and the short list have, which are bounded
        asked = F.broadcast(spark.createDataFrame([(k, i, self.queries[k].tolist()) for k, i in enumerate(self.ids)] if self.probed else [], f"q int, query_id {self.kind}, asked array<double>"))
        short = self.short_list().select("q", F.col("list").alias("of"), F.col("id").alias("short_id"))
        near = self.rows.select("list", "id", "vector").join(short, (F.col("list") == F.col("of")) & F.col("id").eqNullSafe(F.col("short_id"))).join(asked, "q")
        scored = near.select("query_id", "id", (dot(F.col("vector"), F.col("asked")) / norm(F.col("vector"))).alias("similarity"))
        w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= self.limit).select("query_id", "rank", "id", "similarity")
