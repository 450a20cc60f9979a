"""Writers. Each writes a folder; where one file is asked for, rows are ordered and merged by one task."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as tx


def linked_articles(articles: DataFrame, path: str) -> None:
    """JSON lines in input order."""
    rows = schema.raw(articles.orderBy("ordinal")) if "ordinal" in articles.columns else schema.raw(articles)
    rows.write.mode("overwrite").json(path)


def eval_cases(cases: DataFrame, path: str) -> None:
    """One JSON array of cases an article, in article order. cases: article_id, start and further columns."""
    inner = F.struct(*[c for c in cases.columns if c != "article_id"])
    rows = cases.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("start", inner.alias("case")))).alias("c"))
    line = F.to_json(F.transform("c", lambda x: x["case"]))
    rows.orderBy("article_id").select(line.alias("value")).write.mode("overwrite").text(path)


def nested_results(metrics: DataFrame) -> str:
    """Long metrics (mode, base, category, metric, value) -> nested JSON; a metric a.b is b of a. A bounded set of categories."""
    out: dict = {}
    for r in metrics.collect():
        at = out.setdefault(r["mode"], {}).setdefault(r["base"], {}).setdefault(r["category"], {})
        *above, leaf = r["metric"].split(".")
        for name in above:
            at = at.setdefault(name, {})
        at[leaf] = r["value"]
    return json.dumps(out, sort_keys=True)


def metadata(name: str, description: str, linker: str, seconds: float | None, now: datetime) -> str:
    return json.dumps({"experiment_name": name, "experiment_description": description, "linker_name": linker, "timestamp": now.strftime("%Y/%m/%d %H:%M"), "linking_time": seconds})


def separated(df: DataFrame, path: str, separator: str = "\t", order: list | None = None) -> None:
    """Lines of the columns as text, unquoted."""
    rows = df.orderBy(*order) if order else df
    rows.select(F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value")).write.mode("overwrite").text(path)


def key_value_table(df: DataFrame, path: str, key: str = "key") -> None:
    """Parquet, dealt and sorted by key, so that look-ups prune row groups. Empty keys and those over 511 bytes are skipped."""
    size = F.octet_length(key)
    df.where((size > 0) & (size <= 511)).repartition(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def unigrams(counts: DataFrame, path: str) -> None:
    """token count lines in token order."""
    separated(counts.select("token", "n"), path, " ", ["token"])


def article_files(articles: DataFrame, path: str, titles: bool = False) -> None:
    """One text file an article, in a folder named by its number: a partitioned text table."""
    name = F.format_string("article_%05d", F.col("ordinal"))
    if titles:
        name = F.concat(name, F.lit("_"), tx.file_name(F.col("title")))
    articles.select(name.alias("article"), F.col("text").alias("value")).repartition("article").write.mode("overwrite").partitionBy("article").text(path)


def rewritten(original: DataFrame, changed: DataFrame, path: str, key: str = "id") -> None:
    """The articles with labels, title and text of ``changed`` where it has the key; to a new path."""
    new = changed.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in ("labels", "title", "text")])
    put = {c: F.coalesce(f"_{c}", c).alias(c) for c in ("labels", "title", "text")}
    rows = original.join(new, F.col(key) == F.col("_k"), "left").select(*[put.get(c, F.col(c)) for c in original.columns])
    linked_articles(rows, path)


def latex_rows(table: DataFrame) -> list[str]:
    """Lines of a LaTeX table of a small result: percent signs escaped, underscores as spaces."""
    plain = lambda v: "-" if v is None else str(v).replace("_", " ").replace("%", "\\%")
    head = " & ".join(map(plain, table.columns)) + " \\\\"
    return [head, "\\hline", *(" & ".join(map(plain, r)) + " \\\\" for r in table.collect())]


def spanned_header(groups: list[tuple[str, int]]) -> str:
    """Header cells of a tab-separated table: a group over n columns is followed by n - 1 empty cells."""
    return "\t".join("\t".join([name, *[""] * (n - 1)]) for name, n in groups)


def nif_annotations(mentions: DataFrame, base: Column, example: str = "http://example.org/unknown", titles: DataFrame | None = None) -> DataFrame:
    """context, start, end, entity_uri in span order; unknown entities get a fixed address.

    With titles (title, entity_id) the address is that of the entity's page, the fixed one where it has none.
    """
    if titles is not None:
        pages = titles.groupBy(F.col("entity_id").alias("_e")).agg(F.min("title").alias("_title"))
        mentions = mentions.join(pages, F.col("entity_id") == F.col("_e"), "left")
        known = F.concat(F.lit("https://en.wikipedia.org/wiki/"), tx.quote_title(F.col("_title")))
    else:
        known = F.concat(F.lit("http://www.wikidata.org/entity/"), "entity_id")
    uri = F.when(tx.is_unknown(F.col("entity_id")), F.lit(example)).otherwise(F.coalesce(known, F.lit(example)))
    return mentions.select(base.alias("context"), "start", "end", uri.alias("entity_uri")).orderBy("context", "start")


def knowledge_base(candidates: DataFrame, vectors: DataFrame, path: str) -> None:
    """Candidate and vector tables as parquet folders."""
    key_value_table(candidates, f"{path}/candidates", "alias")
    key_value_table(vectors, f"{path}/vectors", "entity_id")


def benchmark(spark: SparkSession, articles: DataFrame, path: str, name: str, description: str, now: datetime) -> str:
    """Write to a new path and return the metadata line; the caller swaps the folders."""
    linked_articles(articles, path)
    return json.dumps({"name": name, "description": description, "timestamp": now.strftime("%Y/%m/%d %H:%M")})
