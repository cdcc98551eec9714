"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Candidates are dealt into blocks, queries too, and each pair of blocks is one step of work. A candidate block has a
sorted list of values for each dimension; a query reads the lists of its positive weights from the top and those of
its negative weights from the bottom, all to the same depth. Every candidate then has a lower bound (what was read, and
each unread list's last value) and an upper bound (what was read, and each unread list's value at the depth reached).
Candidates whose upper bound is below the k-th lower bound are outsiders; when few others are left, or the lists end,
their final scores are resolved, in whole numbers.

The bounds choose the depths. Each query takes its k-th score in one block along to all others, as a floor. The first
depth is where a candidate that no list has shown yet falls below the floor, and each next one is where the bounds are
half as far apart. A block in which nothing can reach the floor isn't read. The steps give each query the candidates at
or above its floor, k a block at most, which a window ranks. All queries of a block go through a round together, as
products of bounded matrices.

Defined results: vectors null or with a null or non-finite component take no part, nor do rows with a null id; only
vectors of the same length meet; a query's own id is no candidate; of several rows with a query's id, the greatest
vector asks; ties go to the smaller id; repeated candidates count as often as they occur; components and scores beyond
the range of a long stand at its ends; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, stow

CANDIDATES_A_BLOCK, QUERIES_A_BLOCK = 8192, 512
#: Rounds after which the lists are read to their ends.
ROUNDS = 4
#: So few candidates a query are resolved at once, however deep the lists have been read.
RESOLVE_SHARE = 0.02
BLOCK_SCHEMA = "block long, dim int, rows int, ids binary, width int, values binary"


def quantised(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", scale: int = 64) -> DataFrame:
    """(id, v): floor(scale * x) of each component x as double, for the vectors that take part."""
    fine = F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(column, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most size rows of (id, v) with vectors of one length, as binary matrices of the narrowest type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dim: int, final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made
            ids, values = (np.concatenate(x) for x in zip(*held[dim], strict=True))
            cut = len(ids) if final else len(ids) // size * size
            for a in range(0, cut, size):
                v = values[a : min(a + size, cut)]
                width = next(w for w in (1, 2, 4, 8) if not v.size or np.abs(v).max() < 1 << (8 * w - 1))
                yield pa.RecordBatch.from_pydict({"block": pa.array([(part << 32) + made], pa.int64()), "dim": pa.array([dim], pa.int32()), "rows": pa.array([len(v)], pa.int32()), "ids": pa.array([ids[a : a + len(v)].tobytes()], pa.binary()), "width": pa.array([width], pa.int32()), "values": pa.array([v.astype(f"i{width}").tobytes()], pa.binary())})
                made += 1
            held[dim] = [(ids[cut:], values[cut:])]

        for batch in batches:
            ids, lists = batch.column("id").to_numpy(zero_copy_only=False), batch.column("v")
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                held.setdefault(int(dim), []).append((ids[at], flat.astype(np.int64).reshape(len(at), dim)))
                if sum(len(x) for x, _ in held[int(dim)]) >= size:
                    yield from block(int(dim), False)
        for dim in list(held):
            if sum(len(x) for x, _ in held[dim]):
                yield from block(dim, True)

    return rows.mapInArrow(run, BLOCK_SCHEMA)


def _half_as_far(gaps: np.ndarray, depth: int) -> int:
    """The depth at which the bounds are half as far apart as at this one."""
    return int(np.searchsorted(-gaps, -gaps[depth] / 2))


def nra(queries: np.ndarray, query_ids: np.ndarray, values: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray | None = None, read: list | None = None) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(query index, candidate index, score) of the k best candidates of each query, those at its floor or above it.
    read gets the share of the lists that each query has read."""
    n, dim = values.shape
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(values).max(initial=0)) * max(1, dim)
    kind = np.float32 if most < 1 << 24 else np.float64
    error = 0.0 if most < 1 << 53 else float(most) * dim * 2.0**-50  # of sums in floating point
    x, lists = values.astype(kind), np.sort(values, axis=0).astype(kind)
    up, down = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
    own = query_ids[:, None] == ids[None, :]
    floor = np.full(len(queries), -np.inf) if floors is None else floors
    # the best that a candidate can have which no list has shown to a depth, and how far its bounds are apart
    best = up @ lists[::-1].T + down @ lists.T
    gaps = (best - (up @ lists[0] + down @ lists[-1])[:, None]).mean(0)
    open_, found = np.flatnonzero(best[:, 0] + error >= floor), []
    outside = best[open_] + error < floor[open_][:, None]
    # where most of the queries' unseen candidates are out, or a quarter without floors
    depth = int(np.median(np.where(outside.any(1), outside.argmax(1), n - 1))) if floors is not None and len(open_) else n // 4 - 1
    for round_ in range(ROUNDS + 1):
        if not len(open_):
            break
        depth = min(max(depth, 0), n - 1)
        last = round_ == ROUNDS or depth == n - 1
        depth = n - 1 if last else depth
        top, bottom = lists[n - 1 - depth], lists[depth]
        seen_up, seen_down = x >= top, x <= bottom
        low = up[open_] @ np.where(seen_up, x, lists[0]).T + down[open_] @ np.where(seen_down, x, lists[-1]).T - kind(error)
        high = low if last and not error else up[open_] @ np.where(seen_up, x, top).T + down[open_] @ np.where(seen_down, x, bottom).T + kind(error)
        low[own[open_]] = -np.inf
        kth = np.maximum(np.partition(low, n - k, axis=1)[:, n - k] if n > k else -np.inf, floor[open_] - error)
        inside = (high >= kth[:, None]) & ~own[open_]
        done = (inside.sum(1) <= max(2 * k, RESOLVE_SHARE * n)) | last
        q, i = np.nonzero(inside[done])
        found.append((open_[done][q], i))
        if read is not None:
            read += [(depth + 1) / n] * int(done.sum())
        open_ = open_[~done]
        depth = max(depth + 1, _half_as_far(gaps, depth))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), []
    q, i = (np.concatenate(x) for x in zip(*found, strict=True))
    whole = np.int64 if most < 1 << 62 else object
    final = (queries[q].astype(whole) * values[i].astype(whole)).sum(1) if len(q) else np.zeros(0, np.int64)
    over = final >= np.array([math.ceil(f) if f > -np.inf else -(1 << 127) for f in floor], object)[q] if whole is object else final >= floor[q]
    q, i, final = q[over], i[over], final[over]
    order = sorted(range(len(q)), key=lambda a: (q[a], -final[a], ids[i[a]])) if whole is object else np.lexsort((ids[i], -final, q))
    q, i, final = q[order], i[order], final[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], i[place < k], [min(max(int(f), -(1 << 63)), (1 << 63) - 1) for f in final[place < k]]


def floor_block(query_block: str, blocks: str) -> Column:
    """The block in which a query block gets its floors: any will do, so they are dealt over all by hash."""
    return F.get(blocks, F.pmod(F.xxhash64(query_block), F.size(blocks)).cast("int"))


def _matrix(row: dict, name: str) -> tuple[np.ndarray, np.ndarray]:
    v = np.frombuffer(row[f"{name}values"], f"i{row[f'{name}width']}").reshape(row[f"{name}rows"], row["dim"])
    return np.frombuffer(row[f"{name}ids"], np.int64), v


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", column: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by every, against all rows."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = quantised(vectors, id_col, column, scale)
    asks = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.max("v").alias("v"))
    blocks = stow(packed(rows, CANDIDATES_A_BLOCK), "candidates")
    queries = stow(packed(asks, QUERIES_A_BLOCK).withColumnsRenamed({c: f"q_{c}" for c in ("block", "rows", "ids", "width", "values")}), "queries")
    # the block numbers, one for thousands of rows; each query block goes to every one of its length
    numbers = blocks.groupBy("dim").agg(F.sort_array(F.collect_list("block")).alias("blocks"))
    spread = queries.join(numbers, "dim")
    parts = max(8, min(20_000, 4 * blocks.count()))

    def met(spread: DataFrame) -> DataFrame:
        return blocks.repartition(parts, "block").join(spread.drop("dim").repartition(parts, "block"), "block")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (ids, values), (query_ids, asked) = _matrix(row, ""), _matrix(row, "q_")
                q, _, score = nra(asked, query_ids, values, ids, k)
                floors = np.full(len(asked), -np.inf)
                n = np.bincount(q, minlength=len(asked))
                floors[n == k] = np.array(score, float)[np.cumsum(n)[n == k] - 1]
                floors -= np.abs(floors) * 2.0**-50  # at most the score itself, though it may not be a double
                yield pa.RecordBatch.from_pydict({"q_of": pa.array([row["q_block"]], pa.int64()), "floors": pa.array([np.nan_to_num(floors, nan=-np.inf, neginf=-np.inf).tobytes()], pa.binary())})

    floors = stow(met(spread.where(F.size("blocks") > 1).withColumn("block", floor_block("q_block", "blocks")).drop("blocks")).mapInArrow(first, "q_of long, floors binary"), "floors")
    spread = spread.join(floors, F.col("q_block") == F.col("q_of"), "left").drop("q_of").withColumn("block", F.explode("blocks")).drop("blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (ids, values), (query_ids, asked) = _matrix(row, ""), _matrix(row, "q_")
                q, i, score = nra(asked, query_ids, values, ids, k, None if row["floors"] is None else np.frombuffer(row["floors"], float))
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(query_ids[q], pa.int64()), "vec_id": pa.array(ids[i], pa.int64()), "score": pa.array(score, pa.int64())})

    found = met(spread).mapInArrow(run, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
