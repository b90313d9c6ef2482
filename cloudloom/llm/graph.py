"""Connected components of a link table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _stars(links: DataFrame, small: bool) -> DataFrame:
    """One step of the star contraction: hang the larger (or, small: the not larger) neighbours of u below its least neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if not small else links
    # in links, a > b always holds
    least = both.groupBy("a").agg(F.min("b").alias("low"))
    if small:
        hung = both.join(least, "a")
        return hung.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b"))).filter("a > b").distinct()
    hung = both.join(least.withColumn("low", F.least("low", "a")), "a").filter("b > a")
    return hung.select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a > b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (a, b) of comparable ids -> (node, component): the least node reachable, for each node that has a link.

    Alternates large-star and small-star steps until nothing changes; raises if `rounds` steps do not get there. Each round is written to the
    shared folder, so a lost executor costs one round at most. Self links and repeats are ignored,
    no links give no rows. The driver only ever sees one row of sums.
    """
    links = links.filter("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = materialize(links, "links"), None
    for _ in range(rounds):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or not mark["n"]:
            break
        before = mark
        now = materialize(_stars(_stars(now, small=False), small=True), "stars")
    else:
        raise RuntimeError(f"components: links still change after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
