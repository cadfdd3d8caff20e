"""Connected components by passing the smallest label along links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import saved


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """id, component (the smallest id in reach) for every id that has a link.

    Alternates two steps until the links stop changing: each node hands the smallest id it sees to its larger
    neighbours, then to its smaller ones. Paths shrink to stars in a logarithmic number of rounds; both steps are joins
    on the node and minima that combine before the shuffle. Each round is written out, so no lineage builds up. The
    minima are written before they meet the links again: then both sides of that join come straight from a shuffle,
    and adaptive execution splits a hub's links over tasks.

    To add links to known components, give the old result's (id, component) rows among the links.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = saved(edges.distinct(), "links")
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = saved(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "lowest")
        up = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(lowest.select("u", F.col("m").alias("v")).unionByName(down).where("u != v").distinct(), "links")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"links still change after {most_rounds} rounds")
    ends = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
