"""Connected components of an edge table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stow

#: Nodes with over a thousandth of the rows are looked up by broadcast; so there are a thousand at most.
HEAVY_SHARE = 1000


def _lowest(links: DataFrame) -> DataFrame:
    """(at, m, n): the smallest neighbour v of each node u, and how many there are."""
    return stow(links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumnRenamed("u", "at"), "lowest")


def _with_lowest(links: DataFrame, low: DataFrame, rows: int) -> DataFrame:
    """links with m of their u. A star's rows all have the same u: those of large stars stay where they are."""
    most = max(1, rows // HEAVY_SHARE)
    heavy, light = low.where(F.col("n") > most), low.where(F.col("n") <= most)
    of = F.col("u") == F.col("at")
    rest = links.join(F.broadcast(heavy.select("at")), of, "left_anti")
    return links.join(F.broadcast(heavy), of).drop("at", "n").unionByName(rest.join(light, of).drop("at", "n"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (u, v); a component is named by its smallest node.

    Each round moves the links of every node to the smallest neighbour, so paths shorten to stars in a number of
    rounds that is about the logarithm of their length.
    """
    edges = stow(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    rows, last = edges.count(), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_lowest(both, _lowest(both), 2 * rows).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        edges = stow(large.where("u <> v").distinct(), "edges")
        low = _lowest(edges)
        small = _with_lowest(edges, low, rows).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select(F.col("at").alias("u"), F.col("m").alias("v")))
        edges = stow(small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == last:
            break
        rows, last = now[0], now
    member = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return member.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
