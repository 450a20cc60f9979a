"""Linkers by name, and the pipeline hyperlinks -> linker or predictions -> coreference.

A linker is a function (articles, resources) -> mentions; further ones can be registered.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation, linking, spans

Linker = Callable[[DataFrame, dict], DataFrame]
LINKERS: dict[str, Linker] = {}
COREFERENCE: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def register(name: str):
    def put(f: Linker) -> Linker:
        LINKERS[name] = f
        return f

    return put


@register("hyperlinks-only")
def _hyperlinks(articles, r):
    return linking.by_hyperlinks(articles, r["titles"], r["redirects"])


@register("hyperlink-reference")
def _reference(articles, r):
    return linking.by_hyperlinks_and_names(articles, r["titles"], r["redirects"], r["names"], r["types"], r["aliases"])


@register("popular-entities")
def _popular(articles, r):
    found = linking.by_popularity(linking.capitalised_spans(articles), r["candidates"], r.get("min_score", 15), r.get("uppercase", False))
    return _mentions(found, "CAPITALISED", "POPULAR")


@register("baseline")
def _prior(articles, r):
    return _mentions(linking.by_prior(linking.capitalised_spans(articles), r["priors"]), "CAPITALISED", "PRIOR")


@register("oracle")
def _oracle(articles, r):
    rows = articles.select(F.col("id").alias("article_id"), F.explode("labels").alias("l")).select("article_id", "l.start", "l.end", "l.entity_id")
    return _mentions(evaluation.gold_as_predictions(rows), "GOLD", "GOLD")


def _mentions(rows: DataFrame, recognised: str, linked: str) -> DataFrame:
    return rows.select("article_id", "start", "end", "entity_id", F.lit(recognised).alias("recognized_by"), F.lit(linked).alias("linked_by"))


@dataclass
class Pipeline:
    """Stages in order; a later stage only adds mentions that overlap none before."""

    linker: str | None = None
    hyperlink_linker: str | None = None
    coreference: str | None = None
    predictions: DataFrame | None = None
    resources: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.linker and self.predictions is not None:
            raise ValueError("either a linker or predictions")
        for name in (self.linker, self.hyperlink_linker):
            if name and name not in LINKERS:
                raise ValueError(f"unknown linker {name!r}; known are {sorted(LINKERS)}")
        if self.coreference and self.coreference not in COREFERENCE:
            raise ValueError(f"unknown coreference resolver {self.coreference!r}")

    def link(self, articles: DataFrame) -> DataFrame:
        parts = [LINKERS[n](articles, self.resources) for n in (self.hyperlink_linker, self.linker) if n]
        if self.predictions is not None:
            parts.append(_mentions(self.predictions, "PREDICTION", "PREDICTION"))
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(spans.not_overlapping(p, out))
        if self.coreference:
            more = COREFERENCE[self.coreference](articles, out)
            out = out.unionByName(spans.not_overlapping(more, out))
        return out


def pronoun_coreference(articles: DataFrame, mentions: DataFrame) -> DataFrame:
    """A simple resolver: personal pronouns refer to the last mention before them in the article."""
    from pyspark.sql import Window

    words = linking_pronouns(articles)
    both = mentions.select("article_id", "start", "end", "entity_id").unionByName(words.withColumn("entity_id", F.lit(None).cast("string")).select("article_id", "start", "end", "entity_id"))
    last = F.last("entity_id", True).over(Window.partitionBy("article_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    rows = both.withColumn("antecedent", last).where("entity_id is null and antecedent is not null")
    return _mentions(rows.withColumn("entity_id", F.col("antecedent")), "PRONOUN", "COREFERENCE")


def linking_pronouns(articles: DataFrame) -> DataFrame:
    from ..operators import exports

    sents = exports.sentences(articles.select("ordinal", "id", "title", "text"), "article")
    toks = exports.tokens(sents)
    return toks.where(F.lower("token").isin("he", "she", "him", "her", "his", "hers")).select(F.col("id").alias("article_id"), "start", "end")


COREFERENCE["pronouns"] = pronoun_coreference


def attach(articles: DataFrame, mentions: DataFrame) -> DataFrame:
    """Articles with their mentions as array entity_mentions, in span order."""
    m = F.struct("start", "end", "entity_id", "recognized_by", "linked_by", F.array().cast("array<string>").alias("candidates"))
    listed = mentions.groupBy(F.col("article_id").alias("_a")).agg(F.array_sort(F.collect_list(m)).alias("entity_mentions"))
    return articles.drop("entity_mentions").join(listed, F.col("id") == F.col("_a"), "left").drop("_a")
