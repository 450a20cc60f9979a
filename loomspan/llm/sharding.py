"""Sharding by a permutation-filled lookup table (native).

Every shard has a preference order of the ``slots`` (a prime) slots: (offset + j * skip) mod slots. The
shards take turns; at its turn a shard claims its next preferred slot that is still free, until all
are taken. Loads differ by one slot at most, and adding a shard moves few slots. The table depends on
shard names and size only, is bounded by ``slots``, and is filled by one SQL ``aggregate`` over the turns.
A row goes to the shard of slot hash(key) mod slots: one look-up in the broadcast table, no shuffle of rows.

Defined results: a null key is hashed as the text "null"; repeated rows go to the same shard; ties can't
arise, as shards take turns in the given order; an empty table gives an empty result; columns of the
input stay, but for those named ``slot`` and ``shard``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def next_prime(n: int) -> int:
    n = max(2, n)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _number(text: Column) -> Column:
    """60 bits of the MD5 of a text, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def lookup_table(spark: SparkSession, shards: list[str], slots: int | None = None) -> DataFrame:
    """slot, shard: ``slots`` rows (default: the first prime of at least 100 slots a shard)."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    slots = slots or next_prime(100 * len(shards))
    if slots < len(shards) or slots != next_prime(slots):
        raise ValueError("slots must be a prime and at least the number of shards")
    names = F.array(*[F.lit(s) for s in shards])
    base = spark.range(1, numPartitions=1).select(
        names.alias("names"),
        F.transform(names, lambda s: _number(F.concat(F.lit("offset:"), s)) % slots).alias("off"),
        F.transform(names, lambda s: _number(F.concat(F.lit("skip:"), s)) % (slots - 1) + 1).alias("skip"),
    )
    # owner: shard (0-based) of each slot or -1; tried: how far each shard is in its order
    state = F.struct(F.array_repeat(F.lit(-1), slots).alias("owner"), F.array_repeat(F.lit(0).cast("long"), len(shards)).alias("tried"))

    def turn(a: Column, t: Column) -> Column:
        i = (t % len(shards)).cast("int")
        slot = lambda j: ((F.get("off", i) + j * F.get("skip", i)) % slots).cast("int")
        ahead = F.sequence(F.get(a["tried"], i), F.lit(slots - 1).cast("long"))
        # the first free slot in the shard's order
        j = F.aggregate(ahead, F.lit(-1).cast("long"), lambda got, j: F.when(got >= 0, got).when(F.get(a["owner"], slot(j)) < 0, j).otherwise(got))
        put = lambda arr, at, value: F.concat(F.slice(arr, F.lit(1), at), F.array(value), F.slice(arr, at + 2, F.size(arr)))
        return F.transform(F.array(j), lambda j: F.struct(put(a["owner"], slot(j), i).alias("owner"), put(a["tried"], i, j + 1).alias("tried")))[0]

    filled = base.select("names", F.aggregate(F.sequence(F.lit(0), F.lit(slots - 1)), state, turn, lambda a: a["owner"]).alias("owner"))
    return filled.select("names", F.posexplode("owner").alias("slot", "o")).select("slot", F.get("names", F.col("o")).alias("shard"))


def place(rows: DataFrame, key: Column, table: DataFrame, slots: int) -> DataFrame:
    """Add slot and shard. ``table`` has ``slots`` rows, a bound set by configuration: it is broadcast."""
    kept = [c for c in rows.columns if c.lower() not in ("slot", "shard")]
    out = rows.select(*kept, (_number(F.coalesce(key.cast("string"), F.lit("null"))) % slots).cast("int").alias("slot"))
    return out.join(F.broadcast(table.select(F.col("slot").alias("__s"), "shard")), F.col("slot") == F.col("__s")).drop("__s")
