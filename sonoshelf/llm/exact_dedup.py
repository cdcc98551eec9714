"""Exact dedup by two passes over a blocked Bloom filter, in DataFrame functions only.

One scan of the texts keeps a slim table of id, hash and SHA-256. The first pass turns every hash to two bits of one
32,768-bit block and keeps the bits that two or more rows hit; the second tests each slim row against them. A row with
a bit that nobody else hit cannot be a copy; only the others are grouped by the SHA-256 of their text. The hashes of
the groups found make a second filter, by which the rows themselves are told apart: those that miss it pass straight
through, without a shuffle, and only the others look up their group.

The hits of the first pass meet as (block, bit) pairs of some ten bytes, which tasks combine first. Bitmaps by task
would be larger: a task's rows lie in as many blocks as it has rows once there are more blocks than that, and each is
a bitmap of 4 KB.

The filters have 16 bits an entry. A filter is broadcast up to ``max_blocks`` blocks of 4 KB (128 MB by default), enough
for 67 million entries. Where the filter of all rows has more, slim rows meet its blocks in a join instead: rows of
blocks with a hot hash by broadcast, of which there are two thousand at most, the others by a shuffle of slim rows. The
filter of groups stays within ``max_blocks``; with more groups than it is made for, more rows look up a group in vain,
which costs a shuffle of theirs and changes no result. So the number of scans of the texts is the same at every size.

Defined results: a null text counts as empty; a null id is smaller than any other; rows that repeat both id and
text are one document and carry the same decision; an empty table gives an empty result. ``decide`` ignores extra
columns, ``keep_one`` returns all columns as they were, whatever their names, and ``mark_copies`` too, but for those
named like a result, which the result replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stow, text_or_empty, unused

BLOCK_BITS = 32_768
BITS_AN_ENTRY = 16
MAX_BLOCKS = 32_768
#: Groups with over a thousandth of the rows are looked up by broadcast; so there are a thousand at most.
HEAVY_SHARE = 1000
RESULTS = ("copy_key", "keep_id", "group_size", "keep_rows", "kept")


def blocks_for(entries: int) -> int:
    return max(1, -(-entries * BITS_AN_ENTRY // BLOCK_BITS))


def places(h: Column, blocks: int) -> list[Column]:
    """The block of a hash, and its two bits there."""
    bits = F.lit(BLOCK_BITS - 1)
    return [F.pmod(h, F.lit(blocks)).alias("block"), F.shiftrightunsigned(h, 17).bitwiseAND(bits).alias("one"), F.shiftrightunsigned(h, 40).bitwiseAND(bits).alias("two")]


def filled(placed: DataFrame, least: int) -> DataFrame:
    """One row per block of (block, one, two) with its bits that at least so many rows hit, and the most that hit one of
    them: (block, bitmap, most)."""
    hit = placed.select("block", F.explode(F.array("one", "two")).alias("bit"))
    often = hit.groupBy("block", "bit").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return often.groupBy("block").agg(F.bitmap_construct_agg(F.col("bit")).alias("bitmap"), F.max("n").alias("most"))


def both_bits(bitmap: str, place: str) -> Column:
    """Whether a bitmap has both bits of a place; not where there is no bitmap."""
    bit = lambda c: F.expr(f"shiftright(cast(conv(hex(substring({bitmap}, cast({place}.{c} div 8 as int) + 1, 1)), 16, 10) as int), cast({place}.{c} % 8 as int)) & 1")
    return F.coalesce((bit("one") + bit("two")) == 2, F.lit(False))


class Copies:
    """What is known of the copies in a table: rows, a slim table of them, the groups of equal texts of two rows or more
    (copy_key, keep_id, group_size, keep_rows), and the filter of their hashes; copy_key is binary here."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, keep: str, max_blocks: int):
        self.id_col, self.text_col, self.max_blocks = id_col, text_col, max_blocks
        key = self.key(text_col)
        self.slim = stow(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("h"), key.alias("copy_key")), "slim")
        self.rows = self.slim.count()
        self.blocks = blocks_for(self.rows)
        self.seen = stow(filled(self.slim.select(*places(F.col("h"), self.blocks)), 2), "seen")
        same = self.suspects().groupBy("copy_key", "h", "id").agg(F.count("*").alias("n"))
        best, first = (F.max, F.col("id").isNotNull()) if keep == "max" else (F.min, F.col("id").isNull())
        groups = same.groupBy("copy_key", "h").agg(best(F.struct(first.alias("has"), "id", "n")).alias("top"), F.sum("n").alias("group_size")).where("group_size > 1")
        self.groups = stow(groups.select("copy_key", "h", F.col("top.id").alias("keep_id"), "group_size", F.col("top.n").alias("keep_rows")), "copies")
        self.marks = min(max_blocks, blocks_for(self.groups.count()))
        self.marked = stow(filled(self.groups.select(*places(F.col("h"), self.marks)), 1).select("block", "bitmap"), "marked")

    @staticmethod
    def key(text_col: str) -> Column:
        return F.unhex(F.sha2(text_or_empty(text_col).cast("binary"), 256))

    def suspects(self) -> DataFrame:
        """The slim rows both of whose bits another row hit too."""
        place = self.slim.select("*", F.struct(*places(F.col("h"), self.blocks)).alias("place")).withColumn("block", F.col("place.block"))
        if self.blocks <= self.max_blocks:
            met = place.join(F.broadcast(self.seen), "block")
        else:
            hot = F.col("most") > max(1, self.rows // HEAVY_SHARE)
            by_broadcast = F.broadcast(self.seen.where(hot))
            met = place.join(by_broadcast, "block").unionByName(place.join(F.broadcast(by_broadcast.select("block")), "block", "left_anti").join(self.seen.where(~hot), "block"))
        return met.where(both_bits("bitmap", "place")).select(self.slim.columns)

    def decisions(self, rows: DataFrame, h: Column, key: Column, id_col: str, names: list[str]) -> DataFrame:
        """rows with keep_id, group_size, keep_rows and kept under these names. Rows that miss the filter, and those of
        large groups, are decided where they are."""
        place, block, bitmap, probe, of, group = unused([*rows.columns, *names], "place", "block", "bitmap", "probe", "of", "group")
        marked = F.broadcast(self.marked.select(F.col("block").alias(block), F.col("bitmap").alias(bitmap)))
        placed = rows.withColumn(place, F.struct(*places(h, self.marks))).join(marked, F.col(f"{place}.block") == F.col(block), "left")
        probed = placed.withColumn(probe, F.when(both_bits(bitmap, place), key)).drop(place, block, bitmap)
        groups = self.groups.select(F.col("copy_key").alias(of), F.struct("keep_id", "group_size", "keep_rows").alias(group))
        large, match = F.col(f"{group}.group_size") > max(1, self.rows // HEAVY_SHARE), F.col(probe) == F.col(of)
        at_once = probed.join(F.broadcast(groups.where(large)), match, "left")
        settled = at_once.where(F.col(probe).isNull() | F.col(of).isNotNull())
        rest = at_once.where(F.col(probe).isNotNull() & F.col(of).isNull()).drop(of, group).join(groups.where(~large), match, "left")
        told, alone, one = settled.unionByName(rest), F.col(of).isNull(), F.lit(1).cast("long")
        keep_id, size, keep_rows, kept = names
        told = told.withColumns({
            keep_id: F.when(alone, F.col(id_col)).otherwise(F.col(f"{group}.keep_id")), size: F.when(alone, one).otherwise(F.col(f"{group}.group_size")),
            keep_rows: F.when(alone, one).otherwise(F.col(f"{group}.keep_rows")),
        })
        return told.withColumn(kept, F.col(id_col).eqNullSafe(F.col(keep_id))).drop(probe, of, group)


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """A row for each row of docs: its id, copy_key (SHA-256 of the text), keep_id (largest or smallest id of equal
    texts, by keep), group_size, keep_rows (rows that have keep_id) and kept, from one scan of docs."""
    copies = Copies(docs, id_col, text_col, keep, max_blocks)
    out = copies.decisions(copies.slim, F.col("h"), F.col("copy_key"), "id", ["keep_id", "group_size", "keep_rows", "kept"])
    return out.select(F.col("id").alias(id_col), F.lower(F.hex("copy_key")).alias("copy_key"), "keep_id", "group_size", "keep_rows", "kept")


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """docs with copy_key, keep_id, group_size, keep_rows and kept, as decide has them."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in RESULTS])
    copies = Copies(docs, id_col, text_col, keep, max_blocks)
    out = copies.decisions(docs.withColumn("copy_key", copies.key(text_col)), F.xxhash64(text_or_empty(text_col)), F.col("copy_key"), id_col, list(RESULTS[1:]))
    return out.withColumn("copy_key", F.lower(F.hex("copy_key")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """One row for each different text, with the columns of docs.

    No row that can't be a copy is shuffled. The choice's own repeats, if there are any, are reduced to one."""
    copies, columns = Copies(docs, id_col, text_col, keep, max_blocks), docs.columns
    names = unused(columns, "keep_id", "group_size", "keep_rows", "kept")
    told = copies.decisions(docs, F.xxhash64(text_or_empty(text_col)), copies.key(text_col), id_col, names).where(F.col(names[3]))
    if copies.groups.where("keep_rows > 1").isEmpty():
        return told.select(columns)
    (key,) = unused(columns, "key")
    repeats = told.where(F.col(names[2]) > 1).withColumn(key, copies.key(text_col)).dropDuplicates([id_col, key])
    return told.where(F.col(names[2]) == 1).select(columns).unionByName(repeats.select(columns))
