"""A Merkle manifest of a table: a tree of SHA-256 per source over its rows, and one over the sources.

Rows are leaves in order of source and id; every ``fanout`` consecutive nodes become their hash, level by level, until
one is left. A source is cut into aligned blocks of a power of the fanout, and each block hashes its own subtree. Then
the blocks exchange roots like a butterfly: in round r, the groups of up to fanout blocks that differ in digit r of
their number (base fanout) swap what they hold, and every member hashes the same parent. So a block learns its upper
proof while the roots rise, and nothing has to come down again. In a run's last, narrower subtree blocks answer for
those that are missing, in turn. The subroots of the sources make a tree in the same way, whose proofs follow theirs.

A round moves one row of digests per block (of 2187 rows, by default); texts are hashed where they are read and not
moved. No task holds more than a block, whatever the size of a source, and no key has more than fanout rows.

Defined results: a null field counts as ``-``, an empty one as ``0:``; a null source is a source of its own and the
first; null ids come first; rows that repeat an id are leaves of their own, ordered by leaf; a source of one row has
its leaf as subroot, and a table of one source its subroot as root; an empty table gives an empty manifest; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bound_batches, stow
from .positions import numbered

FANOUT, BLOCK_LEVELS = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"
Step = tuple[str, str]


def leaf(values: list[Column]) -> Column:
    """The hash of these values, each as its UTF-8 byte count, a colon and itself, or ``-`` for null."""
    told = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in told]), 256)


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def levels_of(nodes: list[str], fanout: int, height: int | None) -> list[list[str]]:
    """The levels over these nodes: height many, or until one node is left."""
    out = [nodes]
    while len(out) <= height if height is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([digest("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return out


def path_in(levels: list[list[str]], at: int, fanout: int) -> list[Step]:
    """What stands left and right of node ``at`` in its run, level by level below the last."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % fanout
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + fanout])))
        at //= fanout
    return out


def fold(node: str, path: list[Step]) -> str:
    """The root that a node and the siblings of its path give."""
    for left, right in path:
        node = digest(left + node + right)
    return node


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):  # a block at a time as Python objects
            yield batch.slice(k, 1).to_pylist()[0]


def _steps(path: list[dict]) -> list[Step]:
    return [(s["left"], s["right"]) for s in path]


def in_blocks(nodes: DataFrame, fanout: int, levels: int, height: Callable[[int], int | None]) -> DataFrame:
    """(tree, part, parts, members, root) from (tree, item, node, pos, size): aligned blocks with their roots."""
    width = fanout**levels
    part, parts = F.floor(F.col("pos") / width).cast("long"), F.ceil(F.col("size") / width).cast("long")
    blocks = nodes.groupBy("tree", part.alias("part"), parts.alias("parts")).agg(F.sort_array(F.collect_list(F.struct("pos", "item", "node"))).alias("members"))

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, many = batch.column("members"), batch.column("parts").to_pylist()
            out = [levels_of(pa.array(lists[k].values.field("node")).to_pylist(), fanout, height(many[k]))[-1][0] for k in range(len(many))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "root"])

    kinds = dict(blocks.dtypes)
    return stow(blocks.mapInArrow(roots, f"tree {kinds['tree']}, part long, parts long, members {kinds['members']}, root string"), "blocks")


def butterfly(blocks: DataFrame, fanout: int) -> DataFrame:
    """(tree, part, top, path) from blocks: the tree's root and the siblings above each block's own root."""
    now = blocks.select("tree", "part", "parts", F.col("root").alias("node"), F.array().cast(PATH).alias("path"))
    most = blocks.agg(F.max("parts")).first()[0] or 0
    span = 1
    while span < most:
        index = F.floor(F.col("part") / span)
        low, group = F.col("part") % span, F.floor(index / fanout)
        # the blocks under this one's node and under the widest node of its group
        width = F.least(F.lit(span), F.col("parts") - index * span)
        widest = F.least(F.lit(span), F.col("parts") - group * (fanout * span))
        sent = now.select("*", group.alias("group"), (index % fanout).alias("digit"), low.alias("low"), F.explode(F.sequence(low, widest - 1, width)).alias("to"))
        own = F.col("to") == F.col("low")
        member = F.struct("digit", "node", F.when(own, F.struct("part", "parts", "path")).alias("own"))
        met = sent.groupBy("tree", "group", "to").agg(F.array_sort(F.collect_list(member), lambda a, b: F.signum(a["digit"].cast("double") - b["digit"]).cast("int")).alias("met"))
        joined = lambda keep: F.array_join(F.transform(F.filter("met", keep), lambda m: m["node"]), "")
        mine = met.select("*", F.explode(F.filter("met", lambda m: m["own"].isNotNull())).alias("me"))
        step = F.struct(joined(lambda m: m["digit"] < F.col("me.digit")).alias("left"), joined(lambda m: m["digit"] > F.col("me.digit")).alias("right"))
        open_ = F.col("me.own.parts") > span
        now = mine.select(
            "tree", "me.own.part", "me.own.parts",
            F.when(open_, F.sha2(joined(lambda m: F.lit(True)), 256)).otherwise(F.col("me.node")).alias("node"),
            F.when(open_, F.concat("me.own.path", F.array(step))).otherwise(F.col("me.own.path")).alias("path"),
        )
        span *= fanout
    return stow(now.select("tree", "part", F.col("node").alias("top"), "path"), "upper")


def prove(leaves: DataFrame, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """A row per row of leaves (source, id, leaf, claimed): id, leaf, subroot, root, path (what stands left and right,
    from the leaf up to the root), proof_sha256 (hash of all siblings in that order), folded_root (from claimed, by the
    path) and verified (whether that is root)."""
    bound_batches(leaves.sparkSession)
    height = lambda parts: block_levels if parts > 1 else None
    id_kind, source_kind = dict(leaves.dtypes)["id"], dict(leaves.dtypes)["source"]

    placed = numbered(leaves, "source", ["id", "leaf"])
    blocks = in_blocks(placed.select(F.col("source").alias("tree"), F.struct("id", "claimed").alias("item"), F.col("leaf").alias("node"), "pos", "size"), fanout, block_levels, height)
    upper = butterfly(blocks, fanout)

    tops = numbered(upper.where("part = 0").select(F.lit(0).alias("tree"), F.col("tree").alias("item"), F.col("top").alias("node")), "tree", ["item"])
    source_blocks = in_blocks(tops, fanout, block_levels, height)
    above = source_blocks.join(butterfly(source_blocks, fanout), ["tree", "part"])

    def of_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("source", kinds_of["source"]), ("subroot", pa.string()), ("above", path_kind), ("all_root", pa.string())])
        for row in _rows(batches):
            members, steps = row["members"], _steps(row["path"])
            levels = levels_of([m["node"] for m in members], fanout, height(row["parts"]))
            paths = [path_in(levels, k, fanout) + steps for k in range(len(members))]
            yield pa.RecordBatch.from_pylist([{"source": m["item"], "subroot": m["node"], "above": [{"left": a, "right": b} for a, b in p], "all_root": row["top"]} for m, p in zip(members, paths, strict=True)], schema)

    path_kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    kinds_of = {"source": pa.string() if source_kind == "string" else pa.int64(), "id": pa.string() if id_kind == "string" else pa.int64()}
    sources = stow(above.mapInArrow(of_sources, f"source {source_kind}, subroot string, above {PATH}, all_root string"), "sources")
    sources = F.broadcast(sources) if sources.count() <= BROADCAST_ROWS else sources
    whole = upper.join(sources, F.col("tree").eqNullSafe(F.col("source"))).select(F.col("tree").alias("of"), F.col("part").alias("of_part"), "subroot", F.concat("path", "above").alias("path"), "all_root")
    ready = blocks.join(whole, F.col("tree").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))).select("parts", "members", "subroot", "path", "all_root")

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", kinds_of["id"]), *[(c, pa.string()) for c in ("leaf", "subroot", "root")], ("path", path_kind), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])
        for row in _rows(batches):
            members, steps, root = row["members"], _steps(row["path"]), row["all_root"]
            levels, upper_siblings, out = levels_of([m["node"] for m in members], fanout, height(row["parts"])), "".join(a + b for a, b in steps), []
            for k, m in enumerate(members):
                path = path_in(levels, k, fanout)
                folded = fold(m["item"]["claimed"], path + steps)
                proof = digest("".join([a + b for a, b in path]) + upper_siblings)
                out.append({"id": m["item"]["id"], "leaf": m["node"], "subroot": row["subroot"], "root": root, "path": [{"left": a, "right": b} for a, b in path + steps], "proof_sha256": proof, "folded_root": folded, "verified": folded == root})
            yield pa.RecordBatch.from_pylist(out, schema)

    return ready.mapInArrow(of_rows, f"id {id_kind}, leaf string, subroot string, root string, path {PATH}, proof_sha256 string, folded_root string, verified boolean")


def tampering(id_col: str = "doc_id") -> Column:
    """Whether the trial of the manifest alters this row: 2 divides the CRC-32 of the id; a null id counts as empty."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 2 == 0


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """The proofs of documents, held against a copy of which some rows lost the line ends of their texts."""
    cut = lambda c: F.when(tampering(), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")) if c == "text" else F.col(c)
    leaves = docs.select("source", F.col("doc_id").alias("id"), leaf([F.col(c) for c in fields]).alias("leaf"), leaf([cut(c) for c in fields]).alias("claimed"))
    return prove(stow(leaves, "leaves"), fanout, block_levels).withColumnRenamed("id", "doc_id")
