"""Connected components over DataFrames of edges, for keys of any ordered type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.plans.lineage import cut, drop
from verdigraph.plans.skew import hub_join


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One step: each node points its larger (or, in a small step, its smaller) neighbours and itself to the least key that it knows.

    Minima are taken before the join, with partial results, and hub_join leaves the rows of a node with very many neighbours where they are.
    ``total`` is at least the number of edges.
    """
    if large:
        near = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
    else:
        near = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
    least = near.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"), F.count("*").alias("n"))
    joined = hub_join(near, least, ["v"], "n", 2 * total)
    if large:
        out = joined.filter("u > v").select(F.col("u").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("u").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("v").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node, component: the least key that can be reached, for every node of ``edges(a, b)``. Self loops and repeated edges don't matter; nulls may not occur.

    Alternating large and small steps turn each component into a star in about log(nodes) ** 2 rounds at worst, a few for stars and short chains. Each
    round is written to the shared folder in place of the one before; its count and hash sum tell when nothing changes. No key comes to the driver.
    """
    now = cut(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    seen, total = None, now.count()
    for _ in range(most_rounds):
        half = cut(_star(now, large=True, total=total), "edges")
        now = cut(_star(half, large=False, total=total), "edges", instead_of=now)
        drop(half)
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen, total = mark, mark[0]
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
