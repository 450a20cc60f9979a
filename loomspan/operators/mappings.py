"""Builders of corpus mappings: counts, link statistics, acronyms, synonyms, key-value tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .resolve import link_to_id


def unigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(tx.word_tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def links(articles: DataFrame) -> DataFrame:
    """id, ordinal, start, end, target, link_text of every hyperlink."""
    out = articles.select("id", "ordinal", "text", F.explode("hyperlinks").alias("l"))
    return out.select("id", "ordinal", F.col("l.start").alias("start"), F.col("l.end").alias("end"), F.col("l.target").alias("target"), tx.snippet(F.col("text"), F.col("l.start"), F.col("l.end")).alias("link_text"))


def link_frequencies(linked: DataFrame) -> DataFrame:
    """link_text, entity_id, n, first (ordinal of the first use). linked: link_text, entity_id (or null), ordinal.

    A text none of whose targets resolves keeps one row with null entity and n = 0.
    """
    counts = linked.groupBy("link_text", "entity_id").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    some = F.max(F.col("entity_id").isNotNull()).over(Window.partitionBy("link_text"))
    counts = counts.withColumn("_some", some).where("entity_id is not null or not _some")
    return counts.select("link_text", "entity_id", F.when(F.col("entity_id").isNull(), 0).otherwise(F.col("n")).cast("long").alias("n"), "first")


def resolved_frequencies(linked: DataFrame) -> DataFrame:
    """The rows of ``link_frequencies`` with n > 0: all links of a text need not meet in one task for them."""
    return linked.where("entity_id is not null").groupBy("link_text", "entity_id").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))


def most_popular_candidates(frequencies: DataFrame) -> DataFrame:
    """link_text, entities: all entities tied at the highest count, first seen first, comma-joined."""
    top = F.rank().over(Window.partitionBy("link_text").orderBy(F.desc("n")))
    best = frequencies.where("entity_id is not null").withColumn("_r", top).where("_r = 1")
    listed = F.array_sort(F.collect_list(F.struct("first", "entity_id")))
    return best.groupBy("link_text").agg(F.array_join(F.transform(listed, lambda x: x["entity_id"].cast("string")), ",").alias("entities"))


def acronyms(linked: DataFrame) -> DataFrame:
    """acronym, targets: from links (link_text, rest, target); rest is the text behind the link.

    An acronym has more than two letters, but no more than the link text has words.
    """
    rows = linked.select(tx.acronym_behind(F.substring("rest", 1, 10)).alias("acronym"), tx.word_count(F.col("link_text")).alias("_n"), "target")
    rows = rows.where((F.length("acronym") > 2) & (F.length("acronym") <= F.col("_n")))
    return rows.groupBy("acronym").agg(F.array_sort(F.collect_set("target")).alias("targets"))


def title_synonyms(bold: DataFrame) -> DataFrame:
    """(bold_text, title) -> bold_text, titles; pages that are lists are skipped."""
    return bold.where(~F.startswith("title", F.lit("List of"))).groupBy("bold_text").agg(F.array_sort(F.collect_set("title")).alias("titles"))


def last_wins(rows: DataFrame, key: str, value: str, order: str = "ordinal") -> DataFrame:
    """One row a key, with the value that comes last in input order (id to title, redirects, single-value tables)."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def abstracts(articles: DataFrame, titles: DataFrame, redirects: DataFrame) -> DataFrame:
    """entity_id, title, abstract (line breaks as spaces); the last article of an entity wins. articles: title, abstract, ordinal."""
    rows = link_to_id(articles, "title", titles, redirects).where("entity_id is not null")
    best = rows.groupBy("entity_id").agg(F.max_by(F.struct("title", F.replace("abstract", F.lit("\n"), F.lit(" ")).alias("abstract")), "ordinal").alias("b"))
    return best.select("entity_id", "b.title", "b.abstract")


def abstract_counters(articles: DataFrame, titles: DataFrame, redirects: DataFrame) -> DataFrame:
    """unmapped, duplicates: articles without an entity, and articles beyond the first of an entity."""
    rows = link_to_id(articles, "title", titles, redirects)
    return rows.agg(F.count_if(F.col("entity_id").isNull()).alias("unmapped"), (F.count("entity_id") - F.count_distinct("entity_id")).alias("duplicates"))


def multi_value(rows: DataFrame, separator: str = ",") -> DataFrame:
    """key, value, ordinal -> key, joined values in input order, repeats kept."""
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "value")))
    return rows.groupBy("key").agg(F.array_join(F.transform(listed, lambda x: x["value"]), separator).alias("value"))


def with_parts(rows: DataFrame, separator: str, change) -> DataFrame:
    """Values that hold several: each part changed, then joined by the same separator."""
    parts = F.split("value", F.lit("\\Q" + separator + "\\E"))
    return rows.withColumn("value", F.array_join(F.transform(parts, lambda x: change(x)), separator))


def inverted(rows: DataFrame, separator: str | None = None) -> DataFrame:
    """Swap key and value; values that hold several are split first."""
    if separator:
        rows = rows.select("ordinal", "key", F.explode(F.split("value", F.lit("\\Q" + separator + "\\E"))).alias("value"))
    return rows.select("ordinal", F.col("value").alias("key"), F.col("key").alias("value"))


def names_by_url(rows: DataFrame) -> DataFrame:
    """Values that are page addresses become page names."""
    return rows.withColumn("value", tx.name_from_url(F.col("value")))


def custom_knowledge_base(triples: DataFrame, name_predicate: str, type_predicate: str) -> dict[str, DataFrame]:
    """names (last object wins by order of appearance, column ordinal), types (list), type_names (name or OTHER)."""
    names = last_wins(triples.where(F.col("p") == name_predicate).select(F.col("s").alias("entity_id"), F.col("o").alias("name"), "ordinal"), "entity_id", "name")
    typed = triples.where(F.col("p") == type_predicate)
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "o")))
    types = typed.groupBy(F.col("s").alias("entity_id")).agg(F.transform(listed, lambda x: x["o"]).alias("types"))
    kinds = typed.select(F.col("o").alias("type_id")).distinct()
    kinds = kinds.join(names.select(F.col("entity_id").alias("_e"), "name"), F.col("type_id") == F.col("_e"), "left")
    return {"names": names, "types": types, "type_names": kinds.select("type_id", F.coalesce("name", F.lit("OTHER")).alias("name"))}


def popular_entity(candidates: DataFrame, min_score: int = 0) -> DataFrame:
    """surface -> the candidate of highest score at least min_score; on ties the lower source rank, then the smaller entity.

    candidates: surface, entity_id, score, source_rank (0 for names, 1 for aliases).
    """
    best = F.row_number().over(Window.partitionBy("surface").orderBy(F.desc("score"), "source_rank", "entity_id"))
    return candidates.where(F.col("score") >= min_score).withColumn("_r", best).where("_r = 1").drop("_r")


def priors(frequencies: DataFrame) -> DataFrame:
    """alias, entity_id, count, prior: shares of an alias's uses."""
    whole = F.sum("n").over(Window.partitionBy("link_text"))
    return frequencies.where("n > 0").select(F.col("link_text").alias("alias"), "entity_id", F.col("n").alias("count"), (F.col("n") / whole).alias("prior"))


def redirects(lines: DataFrame) -> DataFrame:
    """Redirects from the numbered lines of one dump file (ordinal, line): title, target; the last wins.

    The current title is the last <title> before a line. Lines are dealt into blocks: the last title of
    each block is carried on over one row a block, then filled in within the blocks.
    """
    title = F.when(F.contains("line", F.lit("<title>")), F.regexp_extract("line", "<title>(.*?)</title>", 1))
    t = lines.select("ordinal", F.floor(F.col("ordinal") / 65536).alias("block"), title.alias("title"), tx.redirect_target(F.col("line")).alias("target"))
    heads = t.groupBy("block").agg(F.max_by("title", F.when(F.col("title").isNotNull(), F.col("ordinal"))).alias("own"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(F.col("block").alias("_b"), F.last("own", True).over(before).alias("carried"))
    within = Window.partitionBy("block").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    filled = t.join(heads, F.col("block") == F.col("_b")).withColumn("title", F.coalesce(F.last("title", True).over(within), "carried"))
    return last_wins(filled.where("target is not null and title is not null"), "title", "target")


def _swap(left: str, right: str):
    return lambda x: F.when(x == left, F.lit(right)).otherwise(x)


def adjusted_types(types: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Type arrays after (left, REPLACE_WITH | MINUS, right) rules: left becomes right; left goes where right is present."""
    for left, rule, right in rules:
        if rule == "REPLACE_WITH":
            types = F.array_distinct(F.transform(types, _swap(left, right)))
        else:
            types = F.when(F.array_contains(types, right), F.array_remove(types, left)).otherwise(types)
    return types
