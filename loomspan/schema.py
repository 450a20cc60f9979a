"""Explicit schemas of articles, labels, mentions, cases and metadata, and their normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = "struct<start:int,end:int>"
LINK = "struct<start:int,end:int,target:string>"

S, I, L, B, D = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DoubleType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def many(kind: T.DataType) -> T.ArrayType:
    return T.ArrayType(kind)


#: As stored: one JSON object a line. Spans are [start, end]; a hyperlink is [[start, end], target].
RAW_LABEL = struct(id=I, span=many(I), entity_id=S, name=S, type=S, parent=I, children=many(I), optional=B, desc=B, coref=B)
RAW_MENTION = struct(span=many(I), id=S, recognized_by=S, linked_by=S, candidates=many(S))
RAW_ARTICLE = struct(
    id=L, title=S, text=S, url=S, hyperlinks=many(many(S)), title_synonyms=many(many(I)), sections=many(many(S)),
    evaluation_span=many(I), labels=many(RAW_LABEL), entity_mentions=many(RAW_MENTION),
)
_BY_MODE = T.MapType(S, many(S))
RAW_CASES = many(
    struct(
        span=many(I), text=S, candidates=many(struct(entity_id=S, name=S)), predicted_by=S, error_labels=_BY_MODE, factor=D,
        linking_eval_types=_BY_MODE, ner_eval_types=_BY_MODE, optional=B,
        true_entity=struct(id=I, span=many(I), entity_id=S, name=S, type=S, children=many(I)),
        predicted_entity=struct(entity_id=S, name=S, type=S), mention_type=S,
    )
)
METADATA = struct(experiment_name=S, experiment_description=S, linker_name=S, timestamp=S, linking_time=D, name=S, description=S)
PREDICTIONS = struct(id=L, predictions=many(struct(start_char=I, end_char=I, entity_reference=S)))


def span_struct(pair: Column) -> Column:
    """[start, end] -> (start, end)."""
    return F.when(pair.isNotNull(), F.struct(F.get(pair, F.lit(0)).cast("int").alias("start"), F.get(pair, F.lit(1)).cast("int").alias("end")))


def link_struct(pair: Column) -> Column:
    """[[start, end] as text, target] -> (start, end, target)."""
    span = F.from_json(F.get(pair, F.lit(0)), "array<int>")
    return F.struct(F.get(span, F.lit(0)).alias("start"), F.get(span, F.lit(1)).alias("end"), F.get(pair, F.lit(1)).alias("target"))


def _list(name: str, one) -> Column:
    return F.transform(F.coalesce(F.col(name), F.array().cast(RAW_ARTICLE[name].dataType)), one).alias(name)


def normalised(raw: DataFrame) -> DataFrame:
    """Raw articles -> articles with struct spans; absent lists are empty."""
    label = lambda x: F.struct(
        x["id"].alias("id"), F.get(x["span"], F.lit(0)).alias("start"), F.get(x["span"], F.lit(1)).alias("end"),
        *[x[c].alias(c) for c in ("entity_id", "name", "type", "parent", "children")],
        *[F.coalesce(x[c], F.lit(False)).alias(c) for c in ("optional", "desc", "coref")],
    )
    mention = lambda x: F.struct(
        F.get(x["span"], F.lit(0)).alias("start"), F.get(x["span"], F.lit(1)).alias("end"), x["id"].alias("entity_id"),
        x["recognized_by"].alias("recognized_by"), x["linked_by"].alias("linked_by"), x["candidates"].alias("candidates"),
    )
    extra = [c for c in raw.columns if c not in RAW_ARTICLE.names]
    return raw.select(
        *extra, "id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"), "url",
        _list("hyperlinks", link_struct), _list("title_synonyms", span_struct),
        span_struct(F.col("evaluation_span")).alias("evaluation_span"), _list("labels", label), _list("entity_mentions", mention),
    )


def raw(articles: DataFrame) -> DataFrame:
    """Articles -> the stored form."""
    pair = lambda x: F.array(x["start"], x["end"])
    link = lambda x: F.array(F.to_json(pair(x)), x["target"])
    label = lambda x: F.struct(x["id"].alias("id"), pair(x).alias("span"), *[x[c].alias(c) for c in ("entity_id", "name", "type", "parent", "children", "optional", "desc", "coref")])
    mention = lambda x: F.struct(pair(x).alias("span"), x["entity_id"].alias("id"), *[x[c].alias(c) for c in ("recognized_by", "linked_by", "candidates")])
    some = lambda c, one: F.when(F.size(c) > 0, F.transform(c, one)).alias(c)
    return articles.select(
        "id", "title", "text", "url", some("hyperlinks", link), some("title_synonyms", pair),
        F.when(F.col("evaluation_span").isNotNull(), pair(F.col("evaluation_span"))).alias("evaluation_span"),
        some("labels", label), some("entity_mentions", mention),
    )
