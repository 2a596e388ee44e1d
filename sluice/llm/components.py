"""Connected components of a graph given as a table of links, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, materialise, spread_join


def _hubs(links: DataFrame, both: bool, total: int) -> DataFrame | None:
    """Nodes with many links; theirs are dealt to several tasks. both: links count at either end."""
    ends = links.select("a").unionByName(links.select(F.col("b").alias("a"))) if both else links.select("a")
    return hot_keys(ends.groupBy("a").agg(F.count("*").alias("__n")), total)


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Links each node's larger neighbours to the smallest node of its neighbourhood."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
    return spread_join(both, least, ["a"], hot=_hubs(links, True, 2 * total)).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them. Links lead from larger to smaller."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = spread_join(links, least, ["a"], hot=_hubs(links, False, total)).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable, for every node of the links (a long, b long).

    Alternates the two star steps until nothing changes, which takes a number of rounds logarithmic in the nodes.
    Each step is written to the shared folder, so that plans stay short and lost executors cost one step. Nodes with
    many links, as the label of a large component has, are dealt to several tasks. Links with a null end or equal ends
    are ignored; an empty table gives no rows.
    """
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = materialise(ordered, "links"), None
    while True:
        # count and checksum of the set of links; a checksum of sums of hashes does not depend on their order
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        wide = materialise(_large_star(now, mark[0]), "links")  # has no more links than there were
        now = materialise(_small_star(wide, mark[0]), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
