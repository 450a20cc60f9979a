"""What the command line runs: link, evaluate, build benchmarks and tables, export texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import annotated, evaluation, mappings, resolve, spans
from ..sources import readers
from . import registry


# Types of places, and types whose members a demonym names besides (peoples, languages).
PLACE, DEMONYM_TYPES = "Q27096213", ("Q27096213", "Q41710", "Q17376908")


def knowledge(spark: SparkSession, folder: str) -> dict:
    """Resources of the linkers from a folder of parquet tables; absent ones are empty."""
    kinds = {
        "titles": "title string, entity_id string",
        "redirects": "title string, target string",
        "names": "entity_id string, name string",
        "types": "entity_id string, types array<string>",
        "aliases": "entity_id string, aliases array<string>",
        "candidates": "surface string, entity_id string, score long, source_rank int",
        "demonyms": "demonym string",
        "priors": "alias string, entity_id string, count long, prior double",
    }
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda name: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))
    return {k: spark.read.schema(s).parquet(f"{folder}/{k}") if there(k) else spark.createDataFrame([], s) for k, s in kinds.items()}


def link(articles: DataFrame, resources: dict, **stages) -> DataFrame:
    """Articles with their mentions. stages: linker, hyperlink_linker, coreference, predictions."""
    mentions = registry.Pipeline(resources=resources, **stages).link(articles)
    return registry.attach(articles, mentions)


def within_evaluation_span(articles: DataFrame) -> DataFrame:
    """Mentions outside the evaluation span are dropped."""
    s = F.col("evaluation_span")
    kept = F.filter("entity_mentions", lambda m: s.isNull() | ((m["end"] > s["start"]) & (m["start"] < s["end"])))
    return articles.withColumn("entity_mentions", kept)


def labels_of(articles: DataFrame) -> DataFrame:
    rows = articles.select(F.col("id").alias("article_id"), "text", F.explode("labels").alias("l"))
    keep = ("id", "start", "end", "entity_id", "name", "type", "parent", "optional", "coref")
    return rows.select("article_id", *[F.col(f"l.{c}").alias(c) for c in keep], tx.snippet(F.col("text"), F.col("l.start"), F.col("l.end")).alias("text"))


def mentions_of(articles: DataFrame) -> DataFrame:
    rows = articles.select(F.col("id").alias("article_id"), "text", F.explode("entity_mentions").alias("m"))
    keep = ("start", "end", "entity_id", "linked_by", "candidates")
    return rows.select("article_id", *[F.col(f"m.{c}").alias(c) for c in keep], tx.snippet(F.col("text"), F.col("m.start"), F.col("m.end")).alias("text"))


def evaluate(articles: DataFrame, types: DataFrame | None = None, whitelist: DataFrame | None = None, predictions: DataFrame | None = None, coreference: bool = True, unknowns: bool = True, known: dict | None = None, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(typed cases, long metrics: mode, base, category, metric, value) of linked articles with labels.

    known: tables as knowledge() gives them; with them the kinds of wrong disambiguations are told apart.
    wanted: the types of predictions that count, if they are not those of whitelist.
    """
    gold, found = labels_of(articles), predictions if predictions is not None else mentions_of(articles)
    if whitelist is not None:
        gold = evaluation.filter_labels(gold, whitelist)
    wanted = whitelist if wanted is None else wanted
    if wanted is not None and types is not None:
        found = evaluation.filter_predictions(found, types, wanted)
    if not coreference:
        gold = gold.where(~F.col("coref"))
    if not unknowns:
        gold = gold.where(~tx.is_unknown(F.col("entity_id")))
    if types is not None:
        t = types.select(F.col("entity_id").alias("_e"), tx.joined_types(F.col("types")).alias("type"))
        found = found.join(t, F.col("entity_id") == F.col("_e"), "left").drop("_e").withColumn("type", F.coalesce("type", F.lit("OTHER")))
    else:
        found = found.withColumn("type", F.lit("OTHER"))
    typed = evaluation.eval_types(evaluation.cases(gold, found))
    typed = typed.withColumn("text", F.coalesce("gold.text", "predicted.text"))
    typed = typed.withColumn("mention_type", evaluation.mention_type(F.col("text"), F.col("gold.entity_id"), F.col("gold.coref")))
    metrics = ("tp", "fp", "fn", "ground_truth", "precision", "recall", "f1")
    names = {"tp": "true_positives", "fp": "false_positives", "fn": "false_negatives"}

    def long(df: DataFrame, base: str, category) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(names.get(m, m)).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        return df.select("mode", F.lit(base).alias("base"), category.alias("category"), F.explode(cells).alias("c")).select("mode", "base", "category", "c.*")

    out = long(evaluation.mention_type_metrics(typed), "mention_types", F.col("category"))
    out = out.unionByName(long(evaluation.ner_metrics(typed), "error_categories", F.lit("ner")))
    kinds = whitelist if whitelist is not None else articles.sparkSession.createDataFrame([], "type_id string")
    out = out.unionByName(long(evaluation.entity_type_metrics(typed, kinds), "entity_types", F.col("type_id")))
    errors = error_counts(articles, gold, found, typed, known)
    cells = F.array(*[F.struct(F.concat("category", F.lit(f".{c}")).alias("metric"), F.col(c).cast("double").alias("value")) for c in ("errors", "total")])
    modes = F.explode(F.array(*map(F.lit, evaluation.MODES))).alias("mode")
    errors = errors.select("base", "category", F.explode(F.filter(cells, lambda x: x["value"].isNotNull())).alias("c")).select(modes, F.lit("error_categories").alias("b"), "base", "c.*")
    return typed, out.union(errors)


def error_counts(articles: DataFrame, gold: DataFrame, found: DataFrame, typed: DataFrame, known: dict | None = None) -> DataFrame:
    """base, category, errors, total (null where a kind has none) of every kind of error.

    Coreference is left out of the recognition errors: gold coreferences, and pronouns found. Antecedents are not
    in the articles, so of the coreference kinds only those without them are counted.
    """
    pronoun = F.lower("text").isin(*evaluation.PRONOUNS)
    coref = F.coalesce("coref", F.lit(False))
    named, own = found.where(~pronoun), gold.where(~coref & ~pronoun)
    kinds = evaluation.recognition_errors(own, named)
    both = F.explode(F.when(F.col("category") == "wrong_span", F.array("category")).otherwise(F.array("category", F.lit("all")))).alias("category")
    counts = kinds.select("side", both).groupBy("side", "category").agg(F.count("*").alias("errors"))
    span = F.col("evaluation_span")
    words = articles.select(F.explode(tx.word_tokens(F.when(span.isNull(), F.col("text")).otherwise(tx.snippet(F.col("text"), span["start"], span["end"])))).alias("text"))
    totals = evaluation.recognition_totals(own, named, words)
    out = [totals.join(counts, ["side", "category"], "left").select("side", "category", F.coalesce("errors", F.lit(0)).alias("errors"), "total")]

    keys = ["article_id", "start", "end"]
    missed = own.join(named.select(*keys), keys, "left_anti")
    links = articles.select(F.col("id").alias("article_id"), F.explode("hyperlinks").alias("h")).select("article_id", "h.start", "h.end")
    count = lambda rows, side, category, error, total: rows.agg(F.lit(side), F.lit(category), error, total)
    linked = evaluation.undetected_hyperlinks(own, links).join(missed.select(*keys, F.lit(1).alias("_lost")).distinct(), keys, "left")
    out.append(count(linked, "other_errors", "hyperlink", F.count("_lost"), F.count("*")))
    referring = gold.where(coref | pronoun).join(found.select(*keys, F.lit(1).alias("_seen")).distinct(), keys, "left")
    out.append(count(referring, "wrong_coreference", "undetected", F.count_if(F.col("_seen").isNull()), F.count("*")))
    false = evaluation.false_coreference_detections(found.join(gold.select(*keys), keys, "left_anti"))
    out.append(count(false, "wrong_coreference", "false_detection", F.count("*"), F.lit(None).cast("long")))
    if known is not None:
        out.append(evaluation.disambiguation_errors(_pairs(typed, known)).select(F.lit("wrong_disambiguation"), "category", "errors", "total"))
    return reduce(DataFrame.union, out).toDF("base", "category", "errors", "total")


def _pairs(typed: DataFrame, known: dict) -> DataFrame:
    """Recognised mentions with what tells the kinds of wrong disambiguations apart."""
    rows = typed.where(F.col("gold").isNotNull() & F.col("predicted").isNotNull() & F.startswith("mention_type", F.lit("ENTITY")))
    rows = rows.select("text", F.col("gold.entity_id").alias("gold"), F.col("predicted.entity_id").alias("predicted"), F.col("predicted.candidates").alias("candidates"))
    best = mappings.popular_entity(known["candidates"]).select(F.col("surface").alias("_s"), F.col("entity_id").alias("popular"))
    rows = rows.join(best, F.col("text") == F.col("_s"), "left").drop("_s")
    rows = rows.join(known["names"].groupBy(F.col("entity_id").alias("_n")).agg(F.min("name").alias("gold_name")), F.col("gold") == F.col("_n"), "left").drop("_n")
    kinds = known["types"].groupBy("entity_id").agg(F.flatten(F.collect_list("types")).alias("types"))
    for side in ("gold", "predicted", "popular"):
        t = kinds.select(F.col("entity_id").alias("_t"), F.array_contains("types", PLACE).alias(f"{side}_is_place"), F.arrays_overlap("types", F.array(*map(F.lit, DEMONYM_TYPES))).alias(f"{side}_is_demonym_type"))
        rows = rows.join(t, F.col(side) == F.col("_t"), "left").drop("_t")
    names = known["demonyms"].select(F.col("demonym").alias("_d")).distinct()
    return rows.join(names, F.col("text") == F.col("_d"), "left").withColumn("is_demonym", F.col("_d").isNotNull()).drop("_d")


def benchmark_from_annotations(spark: SparkSession, path: str, skip: list[int] | None = None, coreference: bool = True) -> DataFrame:
    """Articles with labels from a bracket-annotated file; ``skip`` lists 1-based article numbers."""
    rows = readers.annotated_text(spark, path).withColumn("ordinal", F.row_number().over(_by_number()) - 1)
    if skip:
        rows = rows.where(~(F.col("ordinal") + 1).isin(*skip))
    labels = annotated.labels(rows.select(F.col("ordinal").cast("long").alias("article_id"), "body"), coreference)
    fields = ("id", "start", "end", "entity_id", "name", "parent", "children", "optional", "desc", "coref")
    listed = labels.groupBy("article_id").agg(F.first("text").alias("text"), F.array_sort(F.collect_list(F.struct(*fields))).alias("labels"))
    return rows.join(listed, F.col("ordinal") == F.col("article_id"), "left").select("ordinal", F.col("ordinal").cast("long").alias("id"), "header", F.coalesce("text", "body").alias("text"), "labels")


def _by_number():
    from pyspark.sql import Window

    return Window.orderBy("number")  # articles of one hand-annotated file


def rendered(articles: DataFrame, mode: str = "labels", ascii_only: bool = False, one_line: bool = False) -> DataFrame:
    """ordinal, title, text with gold labels, links, mentions or nothing (mode plain) written into it."""
    source, how = {
        "labels": ("labels", spans.gold_annotation),
        "links": ("hyperlinks", spans.link_annotation),
        "mentions": ("entity_mentions", spans.mention_annotation),
        "plain": (None, None),
    }[mode]
    text = F.col("text") if source is None else spans.splice(F.col("text"), spans.greedy(F.col(source)), how)
    if ascii_only:
        text = tx.ascii_mask(text)
    if one_line:
        text = tx.flatten_space(text)
    return articles.select("ordinal", "title", text.alias("text"))


def key_value_table(spark: SparkSession, path: str, method: str = "single", inverse: bool = False, separator: str | None = None, names: bool = False) -> DataFrame:
    """key, value: ``single`` (last wins), ``multi`` (comma-joined), ``names`` (page names of addresses, last wins),
    ``popular`` (the entities used most often for each text of a pickled table of counts).

    separator: values hold several parts; with ``inverse`` each becomes a key. names: addresses become page names.
    """
    if method == "popular":
        return mappings.most_popular_candidates(readers.pickled_counts(spark, path)).toDF("key", "value")
    rows = readers.key_values(spark, path)
    if inverse:
        rows = mappings.inverted(rows, separator)
    if names or method == "names":
        if inverse:
            rows = rows.withColumn("key", tx.name_from_url(F.col("key")))
        else:
            rows = mappings.with_parts(rows, separator, tx.name_from_url) if separator else mappings.names_by_url(rows)
    return mappings.multi_value(rows) if method == "multi" else mappings.last_wins(rows, "key", "value")


def relabelled(articles: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Articles with labels, title and text of the benchmark's article in the same place."""
    keep = ("labels", "title", "text")
    place = lambda rows: readers.with_ordinal(rows.withColumnRenamed("ordinal", "_o"), "ordinal", "_o").drop("_o")
    rows = resolve.align(place(articles), place(benchmark).select("ordinal", *keep))
    return rows.withColumns({c: F.col(f"other.{c}") for c in keep}).drop("other")
