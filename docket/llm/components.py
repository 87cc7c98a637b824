"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.session import cut


def _nearest(pairs: DataFrame) -> DataFrame:
    """For each u of (u, v): m, the smallest of u and its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return least.select("u", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the ends of ``edges`` (u, v); component is the smallest node.

    Null ends and loops are left out, repeated edges count once. Each round is
    two joins of the edges with one row per node, written to the shared folder,
    so a hub's edges are never gathered in one group: the minimum is aggregated
    on the map side and the join's hot side can be split. Rounds needed grow
    with the logarithm of the longest chain; beyond ``max_rounds`` it raises.
    """
    now = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    now = cut(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = print_of(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        star = both.join(_nearest(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        star = cut(star)
        small = star.join(_nearest(star), "u")
        now = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = cut(now)
        fresh = print_of(now)
        if fresh == seen:
            break
        seen = fresh
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
