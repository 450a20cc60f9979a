"""Seeded splits and samples. Order comes from a hash of id and seed, so it is the same on every run and cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def _shuffled(key: str, seed: int):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def fixed_size(rows: DataFrame, key: str, dev: int, test: int, seed: int = 42, preset: DataFrame | None = None) -> DataFrame:
    """Add split: ``dev`` and ``test`` rows each, the rest train. preset (key, split) is kept and filled up.

    The limits are top-k selections by hash, so no task orders the whole table.
    """
    given = preset.select(F.col(key).alias("_k"), F.col("split").alias("_s")) if preset is not None else None
    have = {r.split: r["count"] for r in preset.groupBy("split").count().collect()} if preset is not None else {}
    free = rows.join(given, F.col(key) == F.col("_k"), "left_anti") if given is not None else rows
    need = [max(0, dev - have.get("dev", 0)), max(0, test - have.get("test", 0))]
    top = free.select(F.col(key).alias("_k2"), _shuffled(key, seed).alias("_h")).orderBy("_h", "_k2").limit(sum(need))
    n = F.row_number().over(Window.orderBy("_h", "_k2"))
    chosen = top.select("_k2", F.when(n <= need[0], "dev").otherwise("test").alias("_s2"))
    out = rows.join(chosen, F.col(key) == F.col("_k2"), "left")
    if given is not None:
        out = out.join(given, F.col(key) == F.col("_k"), "left")
        return out.withColumn("split", F.coalesce("_s", "_s2", F.lit("train"))).drop("_k", "_s", "_k2", "_s2")
    return out.withColumn("split", F.coalesce("_s2", F.lit("train"))).drop("_k2", "_s2")


def paragraph_window(articles: DataFrame, count: int = 3, seed: int = 31072020, separator: str = "\n\n") -> DataFrame:
    """Add begin and stop: a random run of ``count`` paragraphs of each text (all, if there are fewer)."""
    p = articles.withColumn("_p", tx.paragraphs(F.col("text"), separator))
    room = F.greatest(F.size("_p") - count, F.lit(0))
    first = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), (room + 1).cast("long")).cast("int")
    last = F.least(first + count, F.size("_p")) - 1
    return p.withColumn("begin", F.get("_p", first)["start"]).withColumn("stop", F.get("_p", last)["end"]).drop("_p")
