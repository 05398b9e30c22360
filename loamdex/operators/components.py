"""Connected components over an edge DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loamdex.session import discard, stored

MAX_ROUNDS = 64


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (the smallest node id reachable) for every node that has an edge.

    Alternates large-star and small-star steps until the edge set is a set of stars, which is tested before each
    round, so pairs that are stars already take none; the number of rounds grows with the logarithm of the longest
    path. Each round is two shuffles that pre-aggregate map-side, and its table is written to the shared folder, so
    no lineage builds up and a lost executor repeats one round at most; the table of the round before is deleted. Nothing of the graph comes to the driver.
    """
    pair = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    nodes_alone = edges.where(F.col(src) == F.col(dst)).select(F.col(src).alias("node"), F.col(dst).alias("component"))
    now = stored(pair.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    for _ in range(MAX_ROUNDS):
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty():
            break  # every node has one centre at most, and no centre has another
        # large star: every neighbour above u is tied to the least of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are tied to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, stored(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "components")
        discard(before)
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = nodes_alone.join(stars.unionByName(roots), "node", "left_anti").distinct()
    return stars.unionByName(roots).unionByName(alone)
