"""Reports over evaluation results: flattening, filters, pivots, percentages, sorted tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def flattened(results: DataFrame) -> DataFrame:
    """experiment_id, json (nested results) -> experiment, benchmark, mode, base, category, sub, value.

    Leaves may be numbers, null, or objects of numbers; all are kept as (sub, value). Bounded by the result files.
    """

    def rows():
        for r in results.select("experiment_id", "json").collect():
            name, _, bench = r.experiment_id.rpartition(".")
            for mode, bases in json.loads(r.json).items():
                for base, categories in bases.items():
                    for category, subs in (categories or {}).items():
                        for sub, value in (subs or {}).items():
                            for leaf, v in (value or {}).items() if isinstance(value, dict) else [("", value)]:
                                yield name, bench, mode, base, category, f"{sub}.{leaf}" if leaf else sub, None if v is None else float(v)

    return results.sparkSession.createDataFrame(list(rows()), "experiment string, benchmark string, mode string, base string, category string, sub string, value double")


def shown(rows: DataFrame, pattern: str = "", deprecated: bool = False) -> DataFrame:
    """Rows whose experiment and benchmark names match a pattern (case ignored), without those marked deprecated."""
    out = rows.where(F.rlike(F.concat_ws(" ", "experiment", "benchmark"), F.lit(f"(?i){pattern}")))
    return out if deprecated else out.where(~F.contains(F.lower(F.concat_ws(" ", "experiment", "benchmark")), F.lit("deprecated")))


def hidden(rows: DataFrame, categories: list[str]) -> DataFrame:
    """Without the categories that the configuration hides."""
    return rows.where(~F.col("category").isin(*categories)) if categories else rows


def pivot(rows: DataFrame, value: str = "value", benchmarks: list[str] | None = None) -> DataFrame:
    """One row an experiment, one column a benchmark; what is missing counts 0."""
    return rows.groupBy("experiment").pivot("benchmark", benchmarks).agg(F.first(value)).na.fill(0)


def error_percentage(errors: Column, total: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(errors * 100, total), F.lit(0.0)), 2)


def word_histogram(labels: DataFrame, text: str = "text") -> DataFrame:
    """words (1 to 4, and 5 for more), n."""
    n = F.least(F.size(F.split(F.trim(F.col(text)), r"\s+")), F.lit(5))
    return labels.groupBy(n.alias("words")).agg(F.count("*").alias("n"))


def label_share(part: Column, labels: Column) -> Column:
    return F.coalesce(F.try_divide(part, labels), F.lit(0.0))


def configured_order(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Sorted by place in the configuration, others behind in alphabetical order."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(column)) if order else F.lit(0)
    return rows.orderBy(F.when(at == 0, len(order) + 1).otherwise(at), column)


def sorted_by(rows: DataFrame, column: str, descending: bool = True) -> DataFrame:
    """Numbers by value; cells that are no numbers come last either way."""
    v = F.col(column).cast("string").try_cast("double")
    return rows.orderBy(F.desc_nulls_last(v) if descending else F.asc_nulls_last(v), column)


def benchmark_statistics(labels: DataFrame, root_only: bool = False) -> DataFrame:
    """Per benchmark: labels, unknown, optional, coreference, upper-case and multi-word shares."""
    rows = labels.where("parent is null") if root_only else labels
    n = F.count("*")
    share = lambda c: F.round(label_share(F.count_if(c).cast("double"), n), 6)
    return rows.groupBy("benchmark").agg(
        n.alias("labels"), share(tx.is_unknown(F.col("entity_id"))).alias("unknown"), share(F.col("optional")).alias("optional"),
        share(F.col("coref")).alias("coref"), share(tx.first_letter_is_upper(F.col("text"))).alias("upper"), share(F.contains("text", F.lit(" "))).alias("multi_word"),
    )
