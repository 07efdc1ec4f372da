"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm._base import release, shared_table


def _star(edges: DataFrame, large: bool, made: list[DataFrame]) -> DataFrame:
    """One step over (u, v) pairs: links every neighbour of u to the least of them. The least ones are written, so that
    the join is not tied to their aggregate and the neighbours of a hub can be split over tasks."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = shared_table(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    made.append(least)
    both = near.join(least, "u")
    if large:
        out = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node of its component.

    edges: columns u and v (comparable, not null); loops and repeats are allowed. Each round goes to the shared
    folder, so that neither lineage nor a lost executor matters.
    """
    now = shared_table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before, old = state, [now]
        now = shared_table(_star(_star(now, True, old), False, old), "edges")
        for table in old:  # nothing reads them any more
            release(table)
    raise RuntimeError("components did not settle")
