"""Connected components by alternating star contractions: joins and minima only, nothing gathered per node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (columns u, v): root is the smallest node reachable.

    Each round points neighbours at the smallest neighbour of their larger, then of their smaller side, until
    every edge is a star's.  Minima combine before the shuffle; a star of any degree is only ever joined,
    where skewed sides are split, and never collected.  Rounds grow with the logarithm of the diameter; a graph
    that isn't done after ``rounds`` raises.  No edges give no rows; repeated edges and loops change nothing.
    """
    now = materialise(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    size = now.count()
    for _ in range(rounds):
        if not size:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))  # every edge points down by now
        small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        new = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "edges")
        count = new.count()
        same = count == size and new.join(now, ["u", "v"], "left_anti").isEmpty()  # sets of one size, the one within the other
        release(now)
        now, size = new, count
        if same:
            break
    else:
        raise RuntimeError(f"the components of a graph were not found in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
