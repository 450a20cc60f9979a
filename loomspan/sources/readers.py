"""Readers. Schemas are stated, never inferred; a limit counts input lines."""

from __future__ import annotations

import pickle

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from .ordinal import with_ordinal, with_rank


def _lines(spark: SparkSession, path: str, limit: int = -1) -> DataFrame:
    lines = spark.read.text(path)
    return lines.limit(limit) if limit >= 0 else lines


def articles(spark: SparkSession, path: str, limit: int = -1) -> DataFrame:
    """JSON-lines articles; ordinal follows the order within a file (with gaps between tasks)."""
    raw = spark.read.schema(schema.RAW_ARTICLE).json(path)
    return schema.normalised(with_rank(raw.limit(limit) if limit >= 0 else raw))


def raw_texts(spark: SparkSession, path: str, limit: int = -1) -> DataFrame:
    """One article a line: id is the line number, the title is empty."""
    lines = with_ordinal(_lines(spark, path, limit))
    return lines.select("ordinal", F.col("ordinal").alias("id"), F.lit("").alias("title"), F.col("value").alias("text"))


def extracted_dump(spark: SparkSession, path: str, limit: int = -1) -> DataFrame:
    """Articles as a dump extractor writes them (JSON lines with link and bold spans)."""
    return articles(spark, path, limit)


def dump_lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines of a (bz2) dump."""
    return with_rank(_lines(spark, path)).select("ordinal", F.col("value").alias("line"))


def key_values(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """ordinal, key, value of separated lines; quotes are ordinary characters."""
    parts = F.split("value", separator, 2)
    lines = with_rank(_lines(spark, path)).where(F.contains("value", F.lit(separator)))
    return lines.select("ordinal", F.get(parts, F.lit(0)).alias("key"), F.get(parts, F.lit(1)).alias("value"))


class _Plain(pickle.Unpickler):
    """Refuses everything but plain containers."""

    def find_class(self, module, name):
        if (module, name) in {("collections", "defaultdict"), ("builtins", "set"), ("builtins", "list"), ("builtins", "dict"), ("builtins", "frozenset"), ("builtins", "int")}:
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed")


def pickled_mapping(spark: SparkSession, path: str) -> DataFrame:
    """key, values (array) of a pickled dict of strings, lists, sets or counts. One file, read where the driver runs."""
    with open(path, "rb") as f:
        data = _Plain(f).load()
    many = lambda v: sorted(map(str, v)) if isinstance(v, (list, tuple, set, frozenset, dict)) else [str(v)]
    return spark.createDataFrame([(str(k), many(v)) for k, v in data.items()], "key string, values array<string>")


def pickled_counts(spark: SparkSession, path: str) -> DataFrame:
    """link_text, entity_id, n, first (place in the dict) of a pickled dict of counts by entity. One file, read where the driver runs."""
    with open(path, "rb") as f:
        data = _Plain(f).load()
    rows = [(str(k), str(e), int(n), i) for k, counts in data.items() for i, (e, n) in enumerate(counts.items())]
    return spark.createDataFrame(rows, "link_text string, entity_id string, n long, first long")


def triples(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o of N-Triples lines (Turtle with one full statement a line)."""
    term = r"(<[^>]*>|_:\S+|[A-Za-z][\w-]*:\S*)"
    pattern = rf'^\s*{term}\s+({term[1:-1]}|a)\s+(<[^>]*>|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^\S+)?|\S+?)\s*\.\s*(?:#.*)?$'
    parts = [F.regexp_extract("value", pattern, i) for i in (1, 2, 3)]
    lines = _lines(spark, path).where(F.rlike("value", F.lit(pattern)) & ~F.rlike("value", F.lit(r"^\s*(?:#|@prefix)")))
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"^<(.*)>$", "$1"), r'^"((?:[^"\\]|\\.)*)".*$', "$1")
    return lines.select(*[bare(c).alias(n) for c, n in zip(parts, "spo", strict=True)])


def whitelist(spark: SparkSession, path: str) -> DataFrame:
    """Distinct first Q-id of every line."""
    ids = _lines(spark, path).select(F.regexp_extract("value", "Q[0-9]+", 0).alias("type_id"))
    return ids.where("type_id != ''").distinct()


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """action (ADD, REMOVE), s, p, o of a corrections file; headings and comments are skipped."""
    pattern = r"^(ADD|REMOVE)\s+wd:(Q[0-9]+)\s+wdt:(P[0-9]+)\s+wd:(Q[0-9]+)"
    rows = _lines(spark, path).where(F.rlike("value", F.lit(pattern)))
    return rows.select(*[F.regexp_extract("value", pattern, i).alias(n) for i, n in ((1, "action"), (2, "s"), (3, "p"), (4, "o"))])


def adjustments(spark: SparkSession, path: str) -> DataFrame:
    """left, rule (REPLACE_WITH, MINUS), right of a type adjustments file."""
    pattern = r"^(Q[0-9]+)\s+(REPLACE_WITH|MINUS)\s+(Q[0-9]+)"
    rows = _lines(spark, path).where(F.rlike("value", F.lit(pattern)))
    return rows.select(*[F.regexp_extract("value", pattern, i).alias(n) for i, n in ((1, "left"), (2, "rule"), (3, "right"))])


def benchmarks(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Articles of the named benchmarks (``ALL``: every one in the folder) with column ``benchmark``."""
    glob = f"{folder}/*.benchmark.jsonl"
    rows = spark.read.schema(schema.RAW_ARTICLE).json(glob).withColumn("benchmark", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.benchmark\.jsonl$", 1))
    if "ALL" not in names:
        rows = rows.where(F.col("benchmark").isin(*names))
    return schema.normalised(with_rank(rows))


def results(spark: SparkSession, folder: str) -> DataFrame:
    """experiment_id, kind (eval_results, metadata), json: the result files below a folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    name = F.col("_metadata.file_name")
    files = files.select(F.regexp_extract(name, r"^(.*)\.(eval_results|metadata)\.json$", 1).alias("experiment_id"), F.regexp_extract(name, r"\.(eval_results|metadata)\.json$", 1).alias("kind"), F.col("value").alias("json"))
    return files.where("experiment_id != ''")


def statistics_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(statistics line, case lines up to the first empty line)."""
    rows = with_ordinal(_lines(spark, path))
    end = rows.where(F.trim("value") == "").agg(F.min("ordinal").alias("end"))
    rows = rows.crossJoin(F.broadcast(end)).where("end is null or ordinal < end").drop("end")  # one row
    return rows.where("ordinal = 0").select("value"), rows.where("ordinal > 0").select("ordinal", "value")


def annotated_text(spark: SparkSession, path: str) -> DataFrame:
    """number, header, body of the articles of a bracket-annotated file."""
    whole = spark.read.text(path, wholetext=True)
    parts = F.split("value", r"(?m)^(?=\*{4} ARTICLE)")
    rows = whole.select(F.posexplode(parts).alias("number", "part")).where(F.startswith("part", F.lit("****")))
    head = F.substring_index("part", "\n", 1)
    body = F.regexp_replace(F.substr("part", F.length(head) + 2), r"(?m)^<(?:START|END)>\n?", "")
    return rows.select("number", head.alias("header"), body.alias("body"))


def predictions_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """article_id, start, end, entity_id of simple prediction lines {"id": .., "predictions": [[start, end, entity], ..]}."""
    rows = spark.read.schema(schema.PREDICTIONS).json(path)
    p = F.explode("predictions").alias("p")
    return rows.select(F.col("id").alias("article_id"), p).select("article_id", F.col("p.start_char").alias("start"), F.col("p.end_char").alias("end"), F.col("p.entity_reference").alias("entity_id"))


def predictions_nif(df: DataFrame) -> DataFrame:
    """Triples of a NIF document (s, p, o) -> context, start, end, entity_id of its annotations."""
    by = lambda name: df.where(F.substring_index(F.substring_index("p", "#", -1), "/", -1) == name)
    at = lambda name, to: by(name).select(F.col("s"), F.col("o").alias(to))
    out = at("beginIndex", "start").join(at("endIndex", "end"), "s").join(at("taIdentRef", "entity"), "s").join(at("referenceContext", "context"), "s")
    return out.select("context", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.regexp_extract("entity", "[^/]+$", 0).alias("entity_id"))


def surfaces(spark: SparkSession, path: str) -> DataFrame:
    """surface, title: acronym and synonym tables kept as parquet."""
    return spark.read.schema("surface string, title string").parquet(path)


def _numbered_files(spark: SparkSession, folder: str, pattern: str, kind) -> DataFrame:
    """article_id (the number in the file name), d (the parsed document) of JSON files, one an article."""
    files = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    number = F.regexp_extract(F.col("_metadata.file_name"), "([0-9]+)", 1).cast("long")
    return files.select(number.alias("article_id"), F.from_json("value", kind).alias("d"))


_WIKIDATA_ID = "Q[0-9]+"


def predictions_ambiverse(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """article_id, start, end, entity_id of {"matches": [{"charOffset", "charLength", "entity": {"id"}}]} files."""
    s = schema
    kind = s.struct(matches=s.many(s.struct(charOffset=s.I, charLength=s.I, entity=s.struct(id=s.S))))
    rows = _numbered_files(spark, folder, pattern, kind).select("article_id", F.explode("d.matches").alias("m"))
    found = rows.select("article_id", F.col("m.charOffset").alias("start"), (F.col("m.charOffset") + F.col("m.charLength")).alias("end"), F.regexp_extract("m.entity.id", _WIKIDATA_ID, 0).alias("entity_id"))
    return found.where("entity_id != ''")


def predictions_wikifier(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """article_id, start, end, entity_id of {"annotations": [{"wikiDataItemId", "support": [{"chFrom", "chTo"}]}]} files;
    chTo is the last character. Of annotations with the same span the first stays."""
    s = schema
    kind = s.struct(annotations=s.many(s.struct(wikiDataItemId=s.S, support=s.many(s.struct(chFrom=s.I, chTo=s.I)))))
    rows = _numbered_files(spark, folder, pattern, kind).select("article_id", F.posexplode("d.annotations").alias("n", "a"))
    rows = rows.where("a.wikiDataItemId is not null").select("article_id", "n", F.col("a.wikiDataItemId").alias("entity_id"), F.explode("a.support").alias("s"))
    first = rows.groupBy("article_id", F.col("s.chFrom").alias("start"), (F.col("s.chTo") + 1).alias("end"))
    return first.agg(F.min_by("entity_id", "n").alias("entity_id"))
