"""Connected components of an edge list, by alternating large-star and small-star steps.

All state is in DataFrames; each round is written to the shared folder, so a lost executor costs a
reread. Every step takes minima by partially aggregated groups and joins them back, so no
neighbourhood is gathered; stars with very many leaves are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b) of integer nodes -> (node, root): the smallest node reachable, for nodes with an edge to another."""
    both = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = materialize(both.distinct(), "edges")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        either = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = either.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        large = either.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        moved = large.join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        now = materialize(moved.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
