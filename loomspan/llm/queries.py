"""The queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, mixing, neighbours, oracles, packing, pii, quality, sharding, simhash, suffix_dedup, toxicity
from ._common import materialize

#: Production parameters of the sharding query: 16 shards, a table of 1,601 slots.
SHARDS = [f"shard-{i:02d}" for i in range(16)]
SLOTS = 1601


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _suffix_digest(cut: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op1_suffix_dedup(spark, sf_dir):
    return _suffix_digest(suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents")))


def op2_best_fit_packing(spark, sf_dir):
    return packing.pack(_read(spark, sf_dir, "documents"))


def op3_chat_rotation(spark, sf_dir):
    return chat.rotate(_read(spark, sf_dir, "conversations"))


def op4_shard_lookup(spark, sf_dir):
    table = materialize(sharding.lookup_table(spark, SHARDS, SLOTS), "slots")
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source")
    return sharding.place(docs, F.col("doc_id"), table, SLOTS)


def op5_simhash(spark, sf_dir):
    groups = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_toxicity(spark, sf_dir):
    docs, labels = (_read(spark, sf_dir, t) for t in ("documents", "labels"))
    out = toxicity.held_out(F.col("doc_id"))
    scored = toxicity.score(docs, toxicity.train(docs, labels.where(~out)))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_nearest_neighbours(spark, sf_dir):
    return neighbours.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op8_pii(spark, sf_dir):
    return pii.digest(pii.find(_read(spark, sf_dir, "documents")))


def op9_pareto_mix(spark, sf_dir):
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_quality_rules(spark, sf_dir):
    return quality.quality_rules(_read(spark, sf_dir, "documents")).select("doc_id", *quality.METRICS, "base_failed", "kept")


def queries():
    return {f.__name__: f for f in (op1_suffix_dedup, op2_best_fit_packing, op3_chat_rotation, op4_shard_lookup, op5_simhash, op6_toxicity, op7_nearest_neighbours, op8_pii, op9_pareto_mix, op10_quality_rules)}


def oracle_sql():
    """The rest can't be expressed in DuckDB's SQL (windows of bytes, tokenizers, XXH64 fingerprints, trees, offsets of
    possessive patterns) and is tested by brute force."""
    return {
        "op3_chat_rotation": oracles.CHAT,
        "op4_shard_lookup": oracles.sharding(SHARDS, SLOTS),
        "op7_nearest_neighbours": oracles.NEIGHBOURS,
        "op9_pareto_mix": oracles.MIX,
        "op10_quality_rules": oracles.QUALITY,
    }
