"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined on the map side) and a join, so a node with very many links is no single
task's work, and no links or components come to the driver. Steps are written to the workspace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.storage import Workspace


def _checksum(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the least node around it."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node itself, is linked to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def component_stars(links: DataFrame, work: Workspace, label: str = "links") -> DataFrame:
    """Links (a, b) with the components of links (columns a, b of any orderable type): b is the least node of its component, a
    each other node of it, once. Links of a node to itself are ignored; an empty table gives an empty table."""
    links = work.table(links.select("a", "b").filter("a <> b").distinct(), f"{label}-0")
    before, step = _checksum(links), 0
    while before[0]:
        step += 1
        after = work.table(_small_star(_large_star(links)), f"{label}-{step}")
        if step > 1:
            work.drop(f"{label}-{step - 1}")
        now = _checksum(after)
        links = after
        if now == before:
            break
        before = now
    return links


def connected_components(links: DataFrame, work: Workspace, label: str = "links") -> DataFrame:
    """node, root for every node of links: root is the least node of its component (see `component_stars`)."""
    stars = component_stars(links, work, label)
    roots = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
