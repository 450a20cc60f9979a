"""A training corpus in five stages: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import mixing, packing, pii, quality, simhash
from loomspan.llm._common import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality_rules(docs, carry=True).where("kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by their kinds; n_chars follows the new text."""
    out = pii.mask(pii.find(docs, carry=True))
    new = {"text": F.col("masked"), "n_chars": F.length("masked").cast("long")}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mixing.mix(docs, carry=True).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("SimHash near-duplicates", drop_near_duplicates),
    ("personal data", mask_personal_data),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Hashing of shingles and tokenizing can't be expressed in SQL; the tests check run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = materialize(docs, f"stage{n}")
    return docs
