"""Look-ups: titles to entities, aliases, names, types, candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..storage import cut


def link_to_id(rows: DataFrame, title: str, titles: DataFrame, redirects: DataFrame) -> DataFrame:
    """Add entity_id: of the title itself, else of the title it redirects to, else null.

    titles: (title, entity_id), redirects: (title, target), each with one row a title. Catalyst picks the joins
    (small tables are broadcast by size).
    """
    direct = titles.select(F.col("title").alias("_t1"), F.col("entity_id").alias("_e1"))
    over = redirects.select(F.col("title").alias("_r"), F.col("target").alias("_target"))
    through = over.join(titles.select(F.col("title").alias("_t2"), F.col("entity_id").alias("_e2")), F.col("_target") == F.col("_t2")).select("_r", "_e2")
    out = rows.join(direct, F.col(title) == F.col("_t1"), "left").join(through, F.col(title) == F.col("_r"), "left")
    return out.withColumn("entity_id", F.coalesce("_e1", "_e2")).drop("_t1", "_e1", "_r", "_e2")


def alias_union(*sources: DataFrame) -> DataFrame:
    """(entity_id, aliases): sorted distinct aliases over any number of (entity_id, alias) tables."""
    rows = reduce(DataFrame.unionByName, [s.select("entity_id", "alias") for s in sources])
    return rows.where("alias is not null").groupBy("entity_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def inverse_surface_index(surfaces: DataFrame, titles: DataFrame, redirects: DataFrame) -> DataFrame:
    """(surface, title) -> (entity_id, surfaces); unresolved titles are dropped."""
    rows = link_to_id(surfaces, "title", titles, redirects).where("entity_id is not null")
    return rows.groupBy("entity_id").agg(F.array_sort(F.collect_set("surface")).alias("surfaces"))


def with_name_and_types(rows: DataFrame, names: DataFrame, types: DataFrame) -> DataFrame:
    """Add name and types (array; unknown entities get OTHER) by entity_id."""
    n = names.select(F.col("entity_id").alias("_n"), "name")
    t = types.select(F.col("entity_id").alias("_t"), "types")
    out = rows.join(n, F.col("entity_id") == F.col("_n"), "left").join(t, F.col("entity_id") == F.col("_t"), "left").drop("_n", "_t")
    return out.withColumn("types", F.coalesce("types", F.array(F.lit("OTHER"))))


def annotate_labels(labels: DataFrame, names: DataFrame, types: DataFrame) -> DataFrame:
    """Name and |-joined type of gold labels; unknown entities, quantities and dates keep their own."""
    out = with_name_and_types(labels.drop("name").withColumnRenamed("type", "_own"), names, types)
    keep = tx.is_unknown(F.col("entity_id")) | F.coalesce(F.col("_own").isin("QUANTITY", "DATETIME"), F.lit(False))
    return out.withColumn("type", F.when(keep, F.col("_own")).otherwise(tx.joined_types(F.col("types")))).drop("_own", "types")


def candidates(mentions: DataFrame, priors: DataFrame) -> DataFrame:
    """Mentions (text) with every candidate (alias, entity_id, prior); those without any are dropped."""
    return mentions.join(priors.withColumnRenamed("alias", "_a"), F.col("text") == F.col("_a")).drop("_a")


def candidate_totals(mentions: DataFrame, priors: DataFrame) -> DataFrame:
    """article_id, n_candidates, best: rows that ``candidates`` has for an article, and the highest count among them.

    The candidates of an alias are added up once, before they meet its mentions: mentions times candidates are never rows. The sums
    are cut, so that their size is known: few are broadcast; beside many, adaptive execution deals a frequent text over tasks, from the
    session's threshold for skewed joins on.
    """
    whole = cut(priors.groupBy(F.col("alias").alias("_a")).agg(F.count("*").alias("_n"), F.max("count").alias("_best")), "totals")
    met = mentions.join(whole, F.col("text") == F.col("_a"))
    return met.groupBy("article_id").agg(F.sum("_n").alias("n_candidates"), F.max("_best").alias("best"))


def not_other(types: Column) -> Column:
    """Whether types are anything but exactly [OTHER]."""
    return types != F.array(F.lit("OTHER"))


def align(left: DataFrame, right: DataFrame, key: str = "ordinal") -> DataFrame:
    """Rows of two ordered tables side by side, by their number; the right columns come as struct ``other``."""
    return left.join(right.select(F.col(key).alias("_k"), F.struct("*").alias("other")), F.col(key) == F.col("_k")).drop("_k")


def prefix_lookup(requests: DataFrame, articles: DataFrame, length: int = 100) -> DataFrame:
    """Article of each request by the first characters of its text; the last article with a prefix wins.

    Adds article_id, exact (texts are equal) and shared (articles with that prefix).
    """
    key = F.substring("text", 1, length)
    index = articles.groupBy(key.alias("_k")).agg(F.max_by(F.struct("id", "text"), "ordinal").alias("_a"), F.count("*").alias("shared"))
    out = requests.join(index, key == F.col("_k"), "left")
    return out.select(*requests.columns, F.col("_a.id").alias("article_id"), (F.col("_a.text") == F.col("text")).alias("exact"), "shared")
