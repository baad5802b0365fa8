"""Connected components by alternating large-star and small-star on a DataFrame of links.

Each round is two aggregations (partial before the shuffle) and two joins of the links with one row per node. A node
that holds a large part of all links is joined by broadcast: nodes above a thousandth of the links are at most a
thousand on either side of a link. The links after each round are written to the shared folder, so the plan doesn't
grow and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Workspace, skew_safe_join

#: Links per node from which a node may count as heavy; below this any task can hold them.
HEAVY_FLOOR = 100_000


def _star(links: DataFrame, stats: DataFrame, key: str, total: int) -> DataFrame:
    heavy = None
    if total > HEAVY_FLOOR:
        heavy = stats.where(F.col("deg") > F.lit(max(HEAVY_FLOOR, total // 1000))).drop("deg")
    return skew_safe_join(links, stats.drop("deg"), key, heavy)


def connected_components(links: DataFrame, a: str, b: str, work: Workspace, name: str = "cc") -> DataFrame:
    """``(node, component)`` for every node of ``links``, the component being its smallest node.

    Rows with a null end are ignored, loops and repeated links don't matter, an empty table gives an empty result.
    """
    edges = (
        links.where(f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`")
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct()
    )
    edges = work.write(edges, f"{name}-0")
    total, print_ = _fingerprint(edges)
    if not total:
        return edges.selectExpr("hi as node", "lo as component")
    done = 0
    while True:
        # large star: each larger neighbour of a node is tied to the smallest node of its neighbourhood
        ends = edges.selectExpr("lo as lo", "hi as other").unionByName(edges.selectExpr("hi as lo", "lo as other"))
        least = ends.groupBy("lo").agg(F.min("other").alias("m"), F.count("*").alias("deg"))
        least = least.select("lo", F.least("lo", "m").alias("m"), "deg")
        large = _star(edges, least, "lo", total).selectExpr("hi", "m as lo").distinct()
        # small star: the smaller neighbours of a node and the node itself are tied to the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("deg"))
        tied = _star(large, low, "hi", total)
        small = (
            tied.where("lo <> m")
            .selectExpr("lo as hi", "m as lo")
            .unionByName(low.selectExpr("hi", "m as lo"))
            .distinct()
        )
        done += 1
        new = work.write(small, f"{name}-{done}")
        count, now = _fingerprint(new)
        work.drop(f"{name}-{done - 1}")
        edges = new
        if (count, now) == (total, print_):
            break
        total, print_ = count, now
    tree = edges.selectExpr("hi as node", "lo as component")
    roots = edges.groupBy("lo").agg(F.count("*").alias("n")).selectExpr("lo as node", "lo as component")
    return tree.unionByName(roots)


def _fingerprint(edges: DataFrame) -> tuple[int, object]:
    """Number of links and an order-free hash of them; equal before and after a round at the fixed point."""
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]
