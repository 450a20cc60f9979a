"""Text exports: words, sentences and articles as numbered records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.ordinal import with_ordinal

ENTITY_PREFIX = "<http://www.wikidata.org/entity/"


def sentences(articles: DataFrame, record: str = "sentence") -> DataFrame:
    """record, id, title, number, start, end, sentence of every sentence, in article order.

    A sentence ends behind . ! or ? before white space, or at a line break. Records count from 0 over the whole corpus:
    counts a task give the offsets, so no task sees all rows. With ``record='article'`` the record is the article's.
    """
    pieces = F.split("text", r"(?<=[.!?])(?=[ \t])|(?<=\n)(?=[^\n])", -1)
    rows = articles.select("ordinal", "id", "title", pieces.alias("p")).withColumn("n", F.transform("p", F.length))
    rows = tx.with_starts(rows, "n", "at").select("ordinal", "id", "title", F.posexplode(F.arrays_zip("p", "at")).alias("number", "x"))
    end = F.col("x.at") + F.length("x.p")
    rows = rows.select("ordinal", "id", "title", "number", F.col("x.at").alias("start"), end.alias("end"), F.col("x.p").alias("sentence")).where(F.trim("sentence") != "")
    if record == "article":
        return rows.withColumn("record", F.col("ordinal")).drop("ordinal")
    return with_ordinal(rows, "record", "ordinal", "number").drop("ordinal")


def docs_file(sents: DataFrame) -> DataFrame:
    """record, sentence: line breaks at the ends cut, inner ones as spaces."""
    clean = F.replace(F.regexp_replace("sentence", r"^\n+|\n+$", ""), F.lit("\n"), F.lit(" "))
    return sents.select("record", clean.alias("sentence"))


def _parted(sents: DataFrame, carry: list[str], placed) -> DataFrame:
    """record, id, start, carry and t (m: word, gap: characters before it, at: those of the pieces before) of every word.

    gap and at are null where ``placed`` is false: offsets cost more than words.
    """
    pattern = r"[\p{L}\p{N}_]+"
    rows = sents.select("record", "id", "start", *carry, F.regexp_extract_all("sentence", F.lit(pattern), F.lit(0)).alias("m"), F.when(placed, F.split("sentence", pattern, -1)).alias("p")).where(F.size("m") > 0)
    rows = rows.withColumn("gap", F.transform("p", F.length)).withColumn("n", F.when(F.col("p").isNotNull(), F.transform("m", lambda w, k: F.length(w) + F.get("gap", k)))).drop("p")
    none = F.array().cast("array<int>")
    rows = rows.withColumn("gap", F.coalesce("gap", none)).withColumn("n", F.coalesce("n", none))
    return tx.with_starts(rows, "n", "at").select("record", "id", "start", *carry, F.explode(F.arrays_zip("m", "gap", "at")).alias("t")).where("t.m is not null")


def tokens(sents: DataFrame) -> DataFrame:
    """record, id, start, end, token of words (runs of letters, digits, underscores), offsets in the article."""
    rows = _parted(sents, [], F.lit(True))
    begin = F.col("start") + F.col("t.at") + F.col("t.gap")
    return rows.select("record", "id", begin.alias("start"), (begin + F.length("t.m")).alias("end"), F.col("t.m").alias("token"))


def words_file(sents: DataFrame, mentions: DataFrame) -> DataFrame:
    """word, is_entity, record, score: each token of the sentences, and an entity row for each token within a known mention.

    A sentence meets the mentions of its article once and keeps those that touch it; its words are taken apart in one pass.
    """
    known = mentions.where(~tx.is_unknown(F.col("entity_id"))).groupBy(F.col("article_id").alias("_a")).agg(F.collect_list(F.struct("start", "end", "entity_id")).alias("_m"))
    near = F.filter("_m", lambda m: (m["start"] < F.col("end")) & (m["end"] > F.col("start")))
    rows = sents.select("record", "id", "start", "end", "sentence").join(known, F.col("id") == F.col("_a"), "left").withColumn("spans", near)
    rows = _parted(rows, ["spans"], F.size("spans") > 0)
    begin = F.col("start") + F.col("t.at") + F.col("t.gap")
    own = rows.select("record", "spans", F.col("t.m").alias("word"), begin.alias("begin"), (begin + F.length("t.m")).alias("stop"))
    inside = F.filter("spans", lambda m: (m["start"] <= F.col("begin")) & (F.col("stop") <= m["end"]))
    entity = F.transform(inside, lambda m: F.struct(F.concat(F.lit(ENTITY_PREFIX), m["entity_id"], F.lit(">")).alias("word"), F.lit(1).alias("is_entity")))
    plain = F.array(F.struct("word", F.lit(0).alias("is_entity")))
    out = own.select("record", F.explode(F.when(F.size("spans") > 0, F.concat(plain, F.coalesce(entity, F.filter(plain, lambda _: F.lit(False))))).otherwise(plain)).alias("w"))
    return out.select("w.word", "w.is_entity", "record", F.lit(1).alias("score"))


def articles_file(sents: DataFrame, abstracts: DataFrame, urls: DataFrame) -> DataFrame:
    """record, is_abstract (by the end of the sentence), title, url. abstracts: (id, abstract_end), urls: (id, url)."""
    rows = sents.join(abstracts, "id", "left").join(urls, "id", "left")
    last = F.first("is").over(Window.partitionBy("record").orderBy(F.desc("end")))
    rows = rows.withColumn("is", F.coalesce(F.col("end") <= F.col("abstract_end"), F.lit(False)).cast("int")).withColumn("is_abstract", last)
    return rows.select("record", "is_abstract", "title", "url").distinct()
