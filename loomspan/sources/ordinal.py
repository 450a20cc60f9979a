"""Row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


def with_rank(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """Numbers that follow the order of input and differ, but leave gaps between tasks: no further pass over the data."""
    return df.withColumn(name, F.monotonically_increasing_id())


def with_ordinal(df: DataFrame, name: str = "ordinal", *order) -> DataFrame:
    """Number rows from 0 without gaps, in their order (or that of ``order``): counts by task first, then offsets.

    The tagged rows are written out, as a second evaluation might deal them to other tasks; one row a task takes part
    in the running sum.
    """
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = cut(df.withColumn("__id", F.monotonically_increasing_id()))
    tagged = tagged.withColumn("__part", F.shiftright("__id", 33))
    counts = tagged.groupBy("__part").agg(F.count("*").alias("__n"))
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__base"))
    within = F.col("__id") - F.shiftleft(F.col("__part"), 33)
    joined = tagged.join(F.broadcast(base), F.col("__part") == F.col("__p"))  # one row a task: bounded by the plan
    return joined.withColumn(name, F.col("__base") + within).drop("__id", "__part", "__p", "__base")
