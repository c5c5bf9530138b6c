"""Connected components by alternating large-star and small-star steps.

Each step looks up each vertex's least neighbour, dealt over many places, so the links
of a hub never meet in one task; each step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import summed, written


def _large_star(links: DataFrame) -> DataFrame:
    both = summed(links.union(links.select("b", "a")).toDF("u", "v"), "u", F.col("v"), "v")
    return both.filter("v > u").select(F.col("v").alias("a"), F.least("u", "least_of_key").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = summed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "u", F.col("v"), "v")
    least = F.col("least_of_key")
    # The least neighbour's own row becomes the link from the vertex.
    return down.select(F.when(F.col("v") == least, F.col("u")).otherwise(F.col("v")).alias("a"), least.alias("b"))


def connected_components(links: DataFrame) -> DataFrame:
    """(v, root) for each vertex that has a link in (a, b); root is the component's least vertex.

    Links of a vertex to itself, repeated links and links with a null are ignored.
    """
    now = written(links.select("a", "b").filter("a <> b").distinct(), "links")
    state = None
    while True:
        now = written(_small_star(_large_star(now)).filter("a <> b").distinct(), "links")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    # Every vertex now links to its root alone.
    return now.select(F.col("a").alias("v"), F.col("b").alias("root")).union(now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
