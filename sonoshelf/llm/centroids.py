"""Centroid clustering with exact integers: progressive search over Walsh-Hadamard coefficients.

The transform of 64 integers keeps distances: 64 times the squared distance of two vectors is the sum of the squared
differences of their coefficients. Coefficients are added from coarse (few changes of sign) to fine, in steps that
double. After each step, what is left of vector and centroid bounds what their difference can still add, and centroids
whose lower bound lies strictly above the least upper bound can't be nearest and are dropped; the others go on, and
those that are left at the end have all 64 coefficients and thus exact distances.

Each round is one scan: tasks assign their vectors and give back one row of counts and sums per centroid, which are
summed by centroid and component. Only the centroids (k times 64 integers) come to the driver. No vector is shuffled;
the final assignment is written once, since its sums are joined back to it by centroid (k rows).

Defined results: a vector takes part if it has exactly 64 components, none null or non-finite, and each of them times
``scale`` lies under 2^62 in size, so that it is a long; a null id counts as empty text where first centroids are
chosen, and rows with the same id are chosen in order of their vectors; ties go to the smaller centroid; with fewer than k
vectors there are as many centroids as vectors; a centroid without vectors stays as it was; distances and sums that
no long can hold are null; an empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, stow

DIM = 64
SCALE, LIMIT = 64, 2.0**62
#: Components under this size have coefficients, squares and sums that 64 bits hold; larger ones take Python's integers.
SMALL = 1 << 22
STEPS = (4, 8, 16, 32, 64)
PAIRS = 1 << 19  # vectors times centroids held at a time
MOST_CENTROIDS = 4096


@functools.cache
def by_sequency() -> np.ndarray:
    """The order of the coefficients by the number of sign changes of their rows."""
    h = np.array([[1]])
    while len(h) < DIM:
        h = np.block([[h, h], [h, -h]])
    return np.argsort((np.diff(h, axis=1) != 0).sum(1), kind="stable")


def transform(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard coefficients of each row, coarse to fine."""
    n, width = len(x), 1
    while width < DIM:
        y = x.reshape(n, DIM // (2 * width), 2, width)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, DIM)
        width *= 2
    return x[:, by_sequency()]


def _whole(x: np.ndarray, kind) -> np.ndarray:
    return x.astype(np.int64) if kind != object else np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of rows, exact: by doubles where they hold every sum."""
    if a.dtype != object and np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def _squares(x: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the squared distance and how many coefficient differences it took.

    While more than a fourth of the pairs of rows and centroids is left, a step adds the coefficients of all pairs as one
    matrix product; after that, of those that are left only."""
    w, c = transform(x), transform(centroids)
    kind, shape = w.dtype, (len(x), len(centroids))
    none = np.iinfo(np.int64).max if kind != object else 1 << 200  # above any bound
    part, alive, read, at = np.zeros(shape, kind), np.ones(shape, bool), np.zeros(len(x), np.int64), 0
    for step in STEPS:
        a, b = w[:, at:step], c[:, at:step]
        if 4 * np.count_nonzero(alive) > alive.size:
            part = part + _squares(a)[:, None] - 2 * _products(a, b) + _squares(b)
            read += (step - at) * shape[1]
        else:
            i, j = np.nonzero(alive)
            part[i, j] += _squares(a[i] - b[j])
            read += alive.sum(1) * (step - at)
        at = step
        if step < DIM:
            v, u = _squares(w[:, step:]), _squares(c[:, step:])
            # twice the root of v * u, rounded up well beyond the error of doubles
            cross = _whole(np.ceil(2 * np.sqrt(v.astype(float))[:, None] * np.sqrt(u.astype(float)) * (1 + 1e-9) + 1), kind)
            middle = part + v[:, None] + u
            best = np.where(alive, middle + cross, none).min(1)
            alive &= (middle - cross <= best[:, None]).astype(bool)
    part = np.where(alive, part, none)
    cluster = part.argmin(1)  # the first of the least
    return cluster, part[np.arange(len(x)), cluster] // DIM, read


def scaled(vectors: pa.Array, scale: int) -> np.ndarray:
    """Rows of floor(scale * x), as 64-bit integers where they are small and as Python's otherwise."""
    x = np.floor(scale * pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False)).reshape(-1, DIM)
    return x.astype(np.int64) if not len(x) or np.abs(x).max() < SMALL else np.array([[int(v) for v in row] for row in x], object).reshape(-1, DIM)


def _assigned(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, tuple]]:
    small = all(abs(v) < SMALL for c in centroids for v in c)
    whole = np.array(centroids, object).reshape(-1, DIM)
    rows = max(1, PAIRS // len(centroids))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            piece = batch.slice(at, rows)
            x = scaled(piece.column("vector"), scale)
            if x.dtype == object or not small:
                yield piece, x.astype(object), nearest(x.astype(object), whole)
            else:
                yield piece, x, nearest(x, whole.astype(np.int64))


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, vector) of the vectors that take part."""
    v = F.col(vector_col)
    fits = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < LIMIT))  # NaN is above every number
    return vectors.where((F.size(v) == DIM) & fits).select(F.col(id_col).alias("id"), v.alias("vector"))


def first_centroids(kept: DataFrame, k: int, seed: str, scale: int) -> list[list[int]]:
    """The scaled vectors with the k smallest hashes of seed and id."""
    key = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.withColumn("key", key).orderBy("key", F.col("id").asc_nulls_first(), "vector").limit(k).collect()
    return [[math.floor(scale * float(x)) for x in r.vector] for r in first]


def moved(kept: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """The centroids after one round: the floor of the mean of the vectors that are nearest to each."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for _, x, (cluster, _, _) in _assigned(batches, centroids, scale):
            for c in np.unique(cluster).tolist():
                mine = x[cluster == c]
                n, s = total.get(c, (0, [0] * DIM))
                total[c] = (n + len(mine), [a + int(b) for a, b in zip(s, mine.sum(0), strict=True)])
        rows = [{"cluster": c, "n": n, "sums": [Decimal(v) for v in s]} for c, (n, s) in total.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))]))

    parts = kept.select("vector").mapInArrow(sums, "cluster int, n long, sums array<decimal(38,0)>")
    spread = parts.select("cluster", "n", F.posexplode("sums").alias("at", "s"))
    out = [list(c) for c in centroids]
    for r in spread.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():  # k * 64 rows
        out[r.cluster][r.at] = int(r.s) // r.n
    return out


def _hash(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def _long(v: int | None) -> int | None:
    return None if v is None or v >= 1 << 63 else v


def assign(kept: DataFrame, centroids: list[list[int]], scale: int = SCALE) -> DataFrame:
    """(id, cluster, distance, read) of each vector; read counts the coefficient differences that it took."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, _, (cluster, distance, read) in _assigned(batches, centroids, scale):
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(cluster, pa.int32()), pa.array([_long(int(v)) for v in distance], pa.int64()), pa.array(read)], ["id", "cluster", "distance", "read"])

    return kept.mapInArrow(near, f"id {dict(kept.dtypes)['id']}, cluster int, distance long, read long")


def _sum(c: Column | str) -> Column:
    """The sum where a long can hold it and nothing in it is null, else null."""
    return F.when(F.count("*") == F.count(c), F.try_sum(c))


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: str = "1:", id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """A row per vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and read."""
    if not 1 <= k <= MOST_CENTROIDS:
        raise ValueError(f"k must be from 1 to {MOST_CENTROIDS}")
    spark = vectors.sparkSession
    bound_batches(spark)
    kept = usable(vectors, id_col, vector_col, scale)
    centroids = first_centroids(kept, k, seed, scale)
    kind = dict(kept.dtypes)["id"]
    if not centroids:
        return spark.createDataFrame([], f"{id_col} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, read long")
    for _ in range(rounds):
        centroids = moved(kept, centroids, scale)
    found = stow(assign(kept, centroids, scale), "assigned")
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(_sum("distance").alias("s")).collect()}  # k rows
    known = [sums.get(c, 0) for c in range(len(centroids))]
    inertia = _long(None if None in known else sum(known))
    of = spark.createDataFrame([(c, s, inertia, _hash(centroids[c])) for c, s in sums.items()], "of int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), F.col("cluster") == F.col("of")).select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "read")
