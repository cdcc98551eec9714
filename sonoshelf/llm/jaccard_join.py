"""N-gram Jaccard join by chosen paths: texts whose sets of five-word shingles have a similarity of 0.8 or more.

Texts with the same set are one class, and classes are joined. A class has a MinHash signature of 64 shared-token
samples, which stand for its tokens. In each run all classes start in one bucket. A bucket samples one or two of the 64
places, from its own path, and splits by the values there, so a class goes down a branch for each place; ``SECOND`` is
the chance of a second branch. A bucket of at most ``BUCKET`` classes is compared by brute force; larger ones split
again. What is still large after ``DEPTH`` splits, where texts agree nearly everywhere, is compared with one of them;
those that don't agree with it are compared with all of the bucket, each pair of blocks in a group of its own. A pair at the threshold survives a split with probability 0.8 in each
branch, so runs are repeated until the chance of finding it, with the cut on the signatures counted too, is the target
recall. Signatures that agree well enough link classes to candidate components (as spanning forests, never as all
pairs), and in these the exact similarities are computed from the shingles themselves.

Results, one row per document: class_id (smallest doc_id with the same shingles), n_links (number of other classes
with a similarity of 0.8 or more) and group_id (smallest doc_id that links lead to).

Defined results: words are separated by ASCII white space, and A-Z is lower-cased; a text of one to four words has
them all as its only shingle; texts without words, null ones too, are one class without links; a null id is in its
class but names it only if no other id does; repeated rows are in one class; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import BROADCAST_ROWS, bound_batches, release_held, stow, text_or_empty, trim, unused
from .components import components

WORDS, THRESHOLD = 5, 0.8
PLACES = 64
#: Signatures this similar are candidates: four standard deviations of the estimate below the threshold.
CANDIDATE = 0.6
BUCKET, DEPTH, TARGET_RECALL = 512, 4, 0.9995
#: The chance that a split samples a second place.
SECOND = 0.25
#: Paths with over a thousandth of the rows are looked up by broadcast; so there are a thousand at most.
HEAVY_SHARE = 1000
_SEED = np.random.default_rng(5)
_FACTORS = _SEED.integers(1, 1 << 63, (PLACES, 2), np.uint64) | np.uint64(1)
_WORD_FACTORS = _SEED.integers(1, 1 << 63, WORDS, np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray, factor: int = 0xBF58476D1CE4E5B9) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct shingle hashes of text k are hashes[offsets[k]:offsets[k + 1]]."""
    import xxhash

    release_held()
    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.empty(int(sizes.sum()), object)
    at = 0
    for w in words:
        flat[at : at + len(w)] = w
        at += len(w)
    codes, distinct = pd.factorize(flat)
    table = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], np.uint64)
    h = table[codes] if len(flat) else np.zeros(0, np.uint64)
    # short texts are padded with zeros to one shingle
    owner = np.repeat(np.arange(len(texts)), np.where(sizes > 0, np.maximum(sizes - WORDS + 1, 1), 0))
    counts = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(np.cumsum(sizes) - sizes, counts)
    last = np.repeat(np.cumsum(sizes), counts)
    padded = np.concatenate([h, np.zeros(WORDS, np.uint64)])
    x = np.zeros(len(owner), np.uint64)
    for k in range(WORDS):
        x = x + np.where(first + k < last, padded[first + k], np.uint64(0)) * _WORD_FACTORS[k]
    x = _mixed(x)
    order = np.lexsort((x, owner))
    x, owner = x[order], owner[order]
    fresh = np.ones(len(x), bool)
    fresh[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    x, owner = x[fresh], owner[fresh]
    return x, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int64)


def _nodes(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for the empty one."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    some = np.diff(offsets) > 0
    if some.any():
        out[some] = _mixed(np.add.reduceat(_mixed(x, 0xD6E8FEB86659FD93), offsets[:-1][some]))
    return out.view(np.int64)


def _signatures(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros((len(offsets) - 1, PLACES), np.int32)
    some = np.diff(offsets) > 0
    if some.any():
        for k, (a, b) in enumerate(_FACTORS):
            low = np.minimum.reduceat((x * a + b) >> np.uint64(16), offsets[:-1][some])
            out[some, k] = _mixed(low).astype(np.uint32).view(np.int32)
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, node, n, sig): hash and size of each document's set, and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, offsets = shingles(batch.column("text").to_pylist())
            sig = _signatures(x, offsets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1) * PLACES, pa.int32()), pa.array(sig.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_nodes(x, offsets)), pa.array(np.diff(offsets)), lists], ["doc_id", "node", "n", "sig"])
        trim()

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, node long, n long, sig array<int>")


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 4096) -> Iterator[pa.Table]:
    """Tables of sorted batches in which no group is cut."""
    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) < rows:
            continue
        table = pa.concat_tables(held)
        keys = table[key].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield table.slice(0, cut)
        held = [table.slice(cut)]
    if held:
        yield pa.concat_tables(held)


class _Forest:
    """Union of rows, by smaller index."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        roots = self.roots()
        for i, j in np.unique(np.stack([roots[a], roots[b]], 1)[roots[a] != roots[b]], axis=0) if len(a) else ():
            while self.parent[i] != i:
                i = self.parent[i]
            while self.parent[j] != j:
                j = self.parent[j]
            self.parent[max(i, j)] = min(i, j)


def _in_blocks(members: DataFrame, key: str) -> DataFrame:
    """members, with the size of their group of key, with group and side. Groups of key of at most BUCKET rows are one group with side -1; larger ones are
    cut to blocks, with a group for each pair of blocks and a side for each block in it."""
    cut = F.ceil(F.col("size") / BUCKET).cast("int")
    out = members.withColumn("blocks", cut).withColumn("block", F.pmod(F.xxhash64("node", F.lit(9)), F.col("blocks")).cast("int"))
    out = out.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "with"), F.greatest("block", "with")
    group = F.when(F.col("blocks") == 1, F.col(key)).otherwise(F.xxhash64(key, low, high))
    side = F.when(low == high, -1).otherwise((F.col("block") == high).cast("int"))
    return out.withColumn("group", group).withColumn("side", side.cast("int")).drop("blocks", "block", "with", "size", key)


def _sorted_groups(rows: DataFrame) -> DataFrame:
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group").sortWithinPartitions("group", "node")


def survival(agree: float, depth: int) -> float:
    """The chance that two classes which agree in this share of the places still share a bucket after so many splits."""
    meet = 1.0
    for _ in range(depth):
        apart = 1 - agree * meet
        meet = 1 - (1 - SECOND) * apart - SECOND * apart**2
    return meet


def recall_after(runs: int) -> float:
    """The chance that a pair at the threshold is a candidate after so many runs of DEPTH splits. They all read the same
    places, so it is the mean over the number of places that agree, of which too few to pass CANDIDATE find nothing."""
    agree = lambda a: math.comb(PLACES, a) * THRESHOLD**a * (1 - THRESHOLD) ** (PLACES - a)
    return sum(agree(a) * (1 - (1 - survival(a / PLACES, DEPTH)) ** runs) for a in range(PLACES + 1) if a >= CANDIDATE * PLACES)


def runs_needed(recall: float = TARGET_RECALL) -> int:
    """Runs after which a pair at the threshold is a candidate with the chance recall."""
    runs = next((r for r in range(1, 101) if recall_after(r) >= recall), None)
    if runs is None:
        raise ValueError(f"{PLACES} places and a cut of {CANDIDATE} can't give a recall of {recall}")
    return runs


def _split(rows: DataFrame) -> DataFrame:
    """rows (node, sig, path) a split further down: by the values at one place or two, which the path samples."""
    place = lambda k: F.pmod(F.xxhash64("path", F.lit(k)), F.lit(PLACES))
    step = lambda k: F.xxhash64("path", place(k), F.element_at("sig", (place(k) + 1).cast("int")))
    second = (F.pmod(F.xxhash64("path", F.lit("second")), F.lit(1 << 20)) < int(SECOND * (1 << 20))) & (place(1) != place(2))
    return rows.withColumn("path", F.explode(F.when(second, F.array(step(1), step(2))).otherwise(F.array(step(1)))))


def _looked_up(rows: DataFrame, table: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """rows (n of them) with the columns of table (key, size, ...) for their key, where it has one; size is the number
    of a key's rows. The rows of a large key stay where they are."""
    most, (of,) = max(1, n // HEAVY_SHARE), unused(rows.columns + table.columns, "of")
    table, match = table.withColumnRenamed(key, of), F.col(key) == F.col(of)
    heavy = F.broadcast(table.where(F.col(size) > most))
    rest = rows.join(F.broadcast(heavy.select(of)), match, "left_anti").join(table.where(F.col(size) <= most), match)
    return rows.join(heavy, match).drop(of).unionByName(rest.drop(of))


def buckets(classes: DataFrame, runs: int) -> DataFrame:
    """(node, bucket, size) of the buckets with two classes or more in which the runs end."""
    live = classes.select("node", "sig", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run")).select("node", "sig", F.xxhash64(F.lit("run"), "run").alias("path"))
    ended = []
    for k in range(1, DEPTH + 1):
        # the signatures come again where they are needed: they are larger than all else
        paths = stow(_split(live).select("node", "path"), "paths")
        sizes = stow(paths.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        sized = stow(_looked_up(paths, sizes, "path", "size", paths.count()), "sized")
        large = sizes.where(F.col("size") > BUCKET)
        if k == DEPTH or large.isEmpty():
            ended.append(sized)
            break
        ended.append(sized.where(F.col("size") <= BUCKET))
        live = sized.where(F.col("size") > BUCKET).select("node", "path").join(classes.select("node", "sig"), "node")
    found = ended[0]
    for more in ended[1:]:
        found = found.unionByName(more)
    return found.withColumnRenamed("path", "bucket")


def _apart(group: np.ndarray, side: np.ndarray, forest: _Forest) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same sorted group, and of different sides where there are two, distance by distance, that the
    forest doesn't connect yet. A group that is one tree has none any more."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, int)
    which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(group))))
    i = np.arange(len(group))
    for d in range(1, len(group)):
        i = i[i + d < len(group)]
        i = i[group[i] == group[i + d]]
        if d & (d - 1) == 0 or d % 32 == 0:
            roots = forest.roots()
            i = i[(np.minimum.reduceat(roots, starts) != np.maximum.reduceat(roots, starts))[which[i]]]
        if not len(i):
            return
        two = i[(side[i] < 0) | (side[i] != side[i + d])]
        roots = forest.roots()
        two = two[roots[two] != roots[two + d]]
        yield two, two + d


def _beside_pivot(large: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, groups) of the buckets that no split made small, (node, bucket, size) each.

    Where texts agree nearly everywhere they agree with any one of them too: each bucket has a pivot, and what agrees
    with it is linked to it, in one pass. Only the others are compared with all of the bucket, block by block."""
    n = large.count()
    pivots = large.groupBy("bucket", "size").agg(F.min("node").alias("pivot"))
    pivots = pivots.join(classes.select(F.col("node").alias("pivot"), F.col("sig").alias("pivot_sig")), "pivot")
    agree = F.size(F.filter(F.zip_with("sig", "pivot_sig", lambda a, b: a == b), lambda x: x)) >= CANDIDATE * PLACES
    held = _looked_up(large.drop("size"), pivots, "bucket", "size", n).join(classes.select("node", "sig"), "node")
    held = stow(held.select("node", "bucket", "size", "pivot", agree.alias("near")), "pivots")
    edges = held.where("near and node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v"))
    others = held.groupBy("bucket", "size").agg(F.count_if(~F.col("near")).alias("others")).where("others > 0")
    left = _looked_up(held.select("node", "bucket", "near"), others, "bucket", "size", n)
    blocks = lambda c: F.ceil(F.col(c) / BUCKET).cast("int")
    number = lambda c: F.pmod(F.xxhash64("node", F.lit(9)), blocks(c)).cast("int")
    one = left.where("not near").select("node", F.explode(F.transform(F.sequence(F.lit(0), blocks("size") - 1), lambda k: F.xxhash64("bucket", number("others"), k))).alias("group"), F.lit(0).alias("side"))
    all_ = left.select("node", F.explode(F.transform(F.sequence(F.lit(0), blocks("others") - 1), lambda k: F.xxhash64("bucket", k, number("size")))).alias("group"), F.lit(1).alias("side"))
    return edges, one.unionByName(all_)


def candidate_edges(classes: DataFrame, runs: int) -> DataFrame:
    """(u, v) edges that connect the classes of a bucket whose signatures agree, a spanning forest of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "group"):
            group, side, node = (table[c].to_numpy() for c in ("group", "side", "node"))
            sig = table["sig"].combine_chunks().flatten().to_numpy().reshape(-1, PLACES)
            forest = _Forest(len(group))
            for a, b in _apart(group, side, forest):
                near = (sig[a] == sig[b]).sum(1) >= CANDIDATE * PLACES
                forest.join(a[near], b[near])
            roots = forest.roots()
            linked = roots != np.arange(len(roots))
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[roots[linked]])], ["u", "v"])
        trim()

    met = stow(buckets(classes, runs), "met")
    members, found = met.where(F.col("size") <= BUCKET).select("node", F.col("bucket").alias("group"), F.lit(-1).alias("side")), None
    large = met.where(F.col("size") > BUCKET)
    if not large.isEmpty():
        found, more = _beside_pivot(large, classes)
        members = members.unionByName(more)
    rows = members.join(classes.select("node", "sig"), "node").select("group", "side", "node", "sig")
    edges = _sorted_groups(rows).mapInArrow(run, "u long, v long")
    return (edges if found is None else edges.unionByName(found)).distinct()


def _intersections(sets: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """The size of the intersection of each two sets, by products of incidence matrices over shared elements."""
    sizes = [len(s) for s in sets]
    values, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), sizes)
    shared = counts[codes] > 1
    rank = np.cumsum(counts > 1) - 1
    rows, codes = rows[shared], rank[codes[shared]]
    order = np.argsort(codes, kind="stable")
    rows, codes = rows[order], codes[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int((counts > 1).sum()), chunk):
        a, b = np.searchsorted(codes, [low, low + chunk])
        m = np.zeros((len(sets), chunk), np.float32)
        m[rows[a:b], codes[a:b] - low] = 1
        out += m @ m.T
    return out


def exact_links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(u, v, links) for the classes of reps (node, doc_id, component): links of u counted in one group, v a class
    that those lead to. docs has doc_id and text."""

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, offsets = shingles(batch.column("text").to_pylist())
            same = _nodes(x, offsets) == batch.column("node").to_numpy()  # an id may stand for several texts
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("component"), batch.column("size"), lists], ["node", "component", "size", "hashes"]).filter(pa.array(same))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "group", 1024):
            group, side, node = (table[c].to_numpy() for c in ("group", "side", "node"))
            hashes = table["hashes"].combine_chunks()
            offsets, values = hashes.offsets.to_numpy(), hashes.values.to_numpy()
            u, v, n = [], [], []
            cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(group) else np.zeros(1, int)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                at = a + np.unique(node[a:b], return_index=True)[1]
                sets = [values[offsets[i] : offsets[i + 1]] for i in at]
                sizes = np.array([len(s) for s in sets])
                both = _intersections(sets)
                # similarity of 0.8 or more in whole numbers: 5 * both >= 4 * union
                near = 5 * both >= 4 * (sizes[:, None] + sizes[None, :] - both)
                np.fill_diagonal(near, False)
                if side[a] >= 0:
                    near &= side[at][:, None] != side[at][None, :]
                forest = _Forest(len(at))
                first, second = np.nonzero(np.triu(near))
                forest.join(first, second)
                linked = near.any(1)
                u.append(node[at][linked])
                v.append(node[at][forest.roots()[linked]])
                n.append(near.sum(1)[linked])
            join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([join(u), join(v), join(n)], ["u", "v", "links"])
        trim()

    sizes = reps.groupBy("component").agg(F.count("*").alias("size"))
    wanted = _looked_up(reps.withColumnRenamed("doc_id", "of"), sizes, "component", "size", reps.count())
    small = reps.count() <= BROADCAST_ROWS
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(wanted) if small else wanted, F.col("doc_id").eqNullSafe(F.col("of"))).select("text", "node", "component", "size")
    sets = texts.mapInArrow(with_sets, "node long, component long, size long, hashes array<long>")
    rows = _in_blocks(sets, "component").select("group", "side", "node", "hashes")
    return _sorted_groups(rows).mapInArrow(run, "u long, v long, links long")


def join_similar(docs: DataFrame, recall: float = TARGET_RECALL) -> DataFrame:
    """(doc_id, node, class_id, n_links, group_id), a row for each row of docs (doc_id, text)."""
    sketched = stow(sketches(docs), "sketches")
    classes = stow(sketched.groupBy("node").agg(F.min("doc_id").alias("class_id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    found = components(candidate_edges(classes.where("n > 0"), runs_needed(recall)))
    reps = stow(classes.select("node", F.col("class_id").alias("doc_id")).join(found, "node"), "reps")
    exact = stow(exact_links(docs, reps), "links")
    links = exact.groupBy("u").agg(F.sum("links").alias("n_links"))
    groups = stow(components(exact.select("u", "v")), "groups")
    firsts = groups.join(classes.select("node", "class_id"), "node").groupBy("component").agg(F.min("class_id").alias("group_id"))
    linked = groups.join(firsts, "component").select("node", "group_id").join(links, F.col("node") == F.col("u"), "left").drop("u")
    table = classes.select("node", "class_id").join(linked, "node", "left")
    table = stow(table.select("node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id")), "table")
    return sketched.select("doc_id", "node").join(table, "node").select("doc_id", "node", "class_id", "n_links", "group_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs but for those of groups whose smallest id is another one, with all their columns."""
    node, id_gone, node_gone = unused(docs.columns, "node", "id_gone", "node_gone")
    at, schema = docs.columns.index("text"), StructType([*docs.schema.fields, StructField(node, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = _nodes(*shingles([t or "" for t in batch.column(at).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes)], [*batch.schema.names, node])
        trim()

    gone = join_similar(docs).where(~F.col("doc_id").eqNullSafe(F.col("group_id"))).select(F.col("doc_id").alias(id_gone), F.col("node").alias(node_gone)).distinct()
    gone = stow(gone, "gone")
    small = gone.count() <= BROADCAST_ROWS
    rows = docs.mapInArrow(run, schema)
    kept = rows.join(F.broadcast(gone) if small else gone, (F.col(node) == F.col(node_gone)) & F.col("doc_id").eqNullSafe(F.col(id_gone)), "left_anti")
    return kept.select(docs.columns)
