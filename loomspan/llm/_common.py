"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut as materialize
from ..storage import drop_written as drop_materialized

__all__ = ["BROADCAST_ROWS", "WS_CHARS", "WS_RUN", "drop_materialized", "join_small", "materialize", "small_batches", "tidy", "words_of"]

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, return.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_RUN = "[\\x20\\x09-\\x0D]+"

#: Up to so many rows a keyed side table is broadcast; beyond, it is joined by a salted shuffle.
BROADCAST_ROWS = 50_000


def tidy(f):
    """A map function over Arrow batches that gives its memory back at its end: workers are used again, beside a large JVM.

    Arrow takes its memory from the system's allocator, so that all of it can be given back.
    """

    def run(batches):
        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        yield from f(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):
            ctypes.CDLL(None).malloc_trim(0)

    return run


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Within, Arrow batches of whole texts have so many rows: they lie in the JVM and in each Python worker at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def words_of(text: Column) -> Column:
    """Array of the white-space separated words of a text; null and blank give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_RUN))


def join_small(big: DataFrame, small: DataFrame, keys: list[str], rows: int, salts: int = 64) -> DataFrame:
    """Left join on null-safe ``keys`` with one ``small`` row per key.

    ``rows`` is the counted size of ``small``: within BROADCAST_ROWS it is broadcast; beyond, it is
    repeated for each salt and joined by a shuffle, so that a hot key is spread over ``salts`` tasks.
    """
    right = small.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = None
    for k in keys:
        term = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        on = term if on is None else on & term
    drop = [f"__r_{k}" for k in keys]
    if rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(right), on, "left").drop(*drop)
    right = right.withColumn("__r_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = big.withColumn("__salt", F.floor(F.rand(17) * salts).cast("int"))
    return left.join(right, on & (F.col("__salt") == F.col("__r_salt")), "left").drop("__salt", "__r_salt", *drop)
