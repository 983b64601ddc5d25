"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One step over directed pairs (u, v): hang what each u sees on the smallest id it sees (itself included)."""
    seen = pairs if large else pairs.where("v < u")
    least = seen.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    hung = seen.join(least, "u").where("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:  # u itself hangs on the smallest as well
        hung = hung.union(least.where("m < u").select("u", F.col("m").alias("v")))
    return hung.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (a, b) of any order and repetition -> (id, component) for every id on an edge; component is the
    smallest id reachable. Null ends and loops are ignored. Every step is a min aggregate and a join, so a hub
    of any degree is combined before the shuffle and its join partition can be split; ids never reach the driver."""
    now = (edges.where("a is not null and b is not null and a <> b")
           .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    now = stored(now, "edges")
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not mark[0] or mark == before:
            break
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, large=True)
        now = stored(_star(large, large=False), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # settled: a star around each component's smallest id
    return (now.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))
