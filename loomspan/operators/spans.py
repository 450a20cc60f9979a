"""Span joins and interval operators. Spans are half-open; per-article folds use higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def not_overlapping(spans: DataFrame, covered: DataFrame, key: str = "article_id") -> DataFrame:
    """Spans that overlap none of the covered ones of the same article."""
    c = covered.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return spans.join(c, (F.col(key) == F.col("_k")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")), "left_anti")


def _buckets(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor((F.greatest(end, start + 1) - 1) / width))


def contained(tokens: DataFrame, mentions: DataFrame, key: str = "article_id", width: int = 64, how: str = "inner") -> DataFrame:
    """Tokens with the mention that holds them whole (columns of the mention as struct ``mention``).

    A range join by buckets of ``width`` characters: a mention is repeated for the buckets it touches.
    """
    m = mentions.select(F.col(key).alias("_k"), F.struct("*").alias("mention"), F.explode(_buckets(F.col("start"), F.col("end"), width)).alias("_b"))
    inside = (F.col("start") >= F.col("mention.start")) & (F.col("end") <= F.col("mention.end"))
    return tokens.join(m, (F.col(key) == F.col("_k")) & (F.floor(F.col("start") / width) == F.col("_b")) & inside, how).drop("_k", "_b")


def touching(left: DataFrame, right: DataFrame, key: str = "article_id", width: int = 64) -> DataFrame:
    """Each pair of overlapping spans of one article, once: the left columns, and the right row as struct ``other``.

    A range join by buckets of ``width`` characters; a pair meets in the bucket of its later start.
    """
    ours = left.withColumn("_b", F.explode(_buckets(F.col("start"), F.col("end"), width)))
    theirs = right.select(F.col(key).alias("_k"), F.struct("*").alias("other"), F.explode(_buckets(F.col("start"), F.col("end"), width)).alias("_c"))
    meet = F.floor(F.greatest(F.col("start"), F.col("other.start")) / width) == F.col("_b")
    over = (F.col("start") < F.col("other.end")) & (F.col("other.start") < F.col("end"))
    return ours.join(theirs, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_c")) & meet & over).drop("_b", "_k", "_c")


def greedy(spans: Column) -> Column:
    """Accept spans (structs with start and end) in array order, each if disjoint from those accepted."""
    kind = F.filter(spans, lambda _: F.lit(False))
    return F.aggregate(spans, kind, lambda kept, x: F.when(F.exists(kept, lambda y: overlaps(x, y)), kept).otherwise(F.array_append(kept, x)))


def keep_longer(spans: Column) -> Column:
    """Display order: spans (start, end, has_gold, ...) by start; of two that overlap the longer stays, the earlier
    on a tie; one without gold never replaces one with gold."""
    ordered = F.array_sort(spans)

    def step(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        longer = (x["end"] - x["start"] > last["end"] - last["start"]) & (x["has_gold"] | ~last["has_gold"])
        return (
            F.when(F.size(kept) == 0, F.array(x))
            .when(x["start"] >= last["end"], F.array_append(kept, x))
            .when(longer, F.array_append(F.slice(kept, F.lit(1), F.size(kept) - 1), x))
            .otherwise(kept)
        )

    return F.aggregate(ordered, F.filter(ordered, lambda _: F.lit(False)), step)


def segments(outer: DataFrame, inner: DataFrame, key: str = "article_id") -> DataFrame:
    """Split the outer spans at the bounds of inner spans: key, start, end, outer (its id), inner (id or null).

    Both have key, id, start, end; the spans of one kind are disjoint.
    """
    bounds = outer.unionByName(inner).select(key, F.explode(F.array("start", "end")).alias("start")).distinct()
    piece = bounds.withColumn("end", F.lead("start").over(Window.partitionBy(key).orderBy("start"))).where("end is not null")

    def holder(rows: DataFrame, spans: DataFrame, name: str, how: str) -> DataFrame:
        return contained(rows, spans, key, how=how).withColumn(name, F.col("mention.id")).drop("mention")

    return holder(holder(piece, outer, "outer", "inner"), inner, "inner", "left")


def splice(text: Column, spans: Column, render) -> Column:
    """Replace disjoint spans, from right to left, by ``render(span, snippet)``."""
    from_right = F.reverse(F.array_sort(spans))
    return F.aggregate(
        from_right,
        text,
        lambda t, x: F.concat(F.substr(t, F.lit(1), x["start"]), render(x, F.substr(t, x["start"] + 1, x["end"] - x["start"])), F.substr(t, x["end"] + 1)),
    )


def gold_annotation(x: Column, s: Column) -> Column:
    """[entity:name|text]"""
    return F.concat(F.lit("["), x["entity_id"], F.lit(":"), x["name"], F.lit("|"), s, F.lit("]"))


def link_annotation(x: Column, s: Column) -> Column:
    """[[target]] or [[target|text]] where they differ."""
    return F.when(x["target"] == s, F.concat(F.lit("[["), s, F.lit("]]"))).otherwise(F.concat(F.lit("[["), x["target"], F.lit("|"), s, F.lit("]]")))


def mention_annotation(_: Column, s: Column) -> Column:
    return F.concat(F.lit("[["), s, F.lit("]]"))


def entity_list(spans: Column) -> Column:
    """Distinct entities of spans in order of appearance, one entity:name a line."""
    return F.array_join(F.array_distinct(F.transform(F.array_sort(spans), lambda x: F.concat(x["entity_id"], F.lit(":"), x["name"]))), "\n")


def longest_names(docs: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, start_word, n_words, name: the longest name that begins at each word.

    Runs of as many words as some name has are built within the text's row, so that no row repeats its words, and joined with the
    names by hash. names (name) are space-joined words, of any length.
    """
    known = names.select(F.col("name").alias("_n")).distinct()
    many = [r.n for r in known.select(F.size(F.split("_n", " ")).alias("n")).distinct().collect()]  # at most the longest name's words
    words = docs.select("doc_id", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w"))

    def runs_of(n: int) -> Column:
        run = lambda i: F.struct(i.alias("start_word"), F.lit(n).alias("n_words"), F.array_join(F.slice("w", i + 1, F.lit(n)), " ").alias("name"))
        return F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), run))

    none = F.array().cast("array<struct<start_word:int,n_words:int,name:string>>")
    grams = words.select("doc_id", F.explode(F.concat(none, *[F.coalesce(runs_of(n), none) for n in sorted(many)])).alias("g")).select("doc_id", "g.*")
    found = grams.join(known, F.col("name") == F.col("_n"), "left_semi")
    return found.groupBy("doc_id", "start_word").agg(F.max_by(F.struct("n_words", "name"), "n_words").alias("b")).select("doc_id", "start_word", "b.n_words", "b.name")


def accept_disjoint(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Left to right, the names (start_word, n_words, name) that begin behind the last one accepted; the word behind a
    name is skipped as a start."""
    rows = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_word", "n_words", "name"))).alias("r"))
    state = F.struct(F.lit(0).alias("next"), F.filter("r", lambda _: F.lit(False)).alias("out"))
    step = lambda a, x: F.when(x["start_word"] < a["next"], a).otherwise(F.struct((x["start_word"] + x["n_words"] + 1).alias("next"), F.array_append(a["out"], x).alias("out")))
    return rows.select(key, F.explode(F.aggregate("r", state, step, lambda a: a["out"])).alias("x")).select(key, "x.*")
