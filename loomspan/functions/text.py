"""Scalar text functions, all built from Spark's own expressions.

Offsets are code points, 0-based, end exclusive. Character classes are spelled out as Unicode
categories, since ``\\w`` and ``\\W`` of the JVM are ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NON_WORD = r"[^\p{L}\p{N}_]+"
WORD_OR_QUOTE = r"[\p{L}\p{N}_']+"
URL_PREFIX = "https://en.wikipedia.org/wiki/"
UNKNOWN_ENTITIES = ("<NIL>", "<NO_MAPPING>")
PRONOUN_FALSE_DETECTIONS = ("It", "it", "This", "this", "That", "that", "Its", "its")


def snippet(text: Column, start: Column, end: Column) -> Column:
    """The characters from start to end."""
    return F.substring(text, start + 1, end - start)


def word_tokens(text: Column) -> Column:
    """Maximal runs of letters, digits and underscores."""
    return F.filter(F.split(text, NON_WORD), lambda w: w != "")


def ascii_mask(text: Column) -> Column:
    """Every character outside ASCII becomes an underscore."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", "_")


def flatten_space(text: Column) -> Column:
    """Every white-space character becomes a space."""
    return F.regexp_replace(text, r"(?U)\s", " ")


def strip_brackets(title: Column) -> Column:
    """Without parenthesised parts and the space before them."""
    return F.regexp_replace(title, r" \([^)]*?\)", "")


def is_all_lower(s: Column) -> Column:
    """Lower case with at least one cased character."""
    return (F.lower(s) == s) & F.rlike(s, F.lit(r"\p{Ll}"))


def name_from_url(url: Column, prefix: str = URL_PREFIX) -> Column:
    """Readable page name: prefix cut, percent codes decoded (a plus sign stays), underscores as spaces."""
    rest = F.when(F.startswith(url, F.lit(prefix)), F.substring(url, len(prefix) + 1, 1_000_000)).otherwise(url)
    return F.replace(F.url_decode(F.replace(rest, F.lit("+"), F.lit("%2B"))), F.lit("_"), F.lit(" "))


def quote_title(title: Column) -> Column:
    """Page path of a title: spaces as underscores, the rest percent-encoded except slashes."""
    out = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for code, char in (("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def file_name(title: Column) -> Column:
    return F.translate(title, " /", "__")


def strip_description(text: Column) -> Column:
    """A leading {...} part removed."""
    return F.when(F.startswith(text, F.lit("{")), F.element_at(F.split(text, r"\}", 3), 2)).otherwise(text)


def acronym_behind(rest: Column) -> Column:
    """Capitals in parentheses right behind a link, or an empty string."""
    return F.regexp_extract(rest, r"^ \(([A-Z]+)\)", 1)


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD_OR_QUOTE), F.lit(0)))


def joined_types(types: Column) -> Column:
    return F.array_join(types, "|")


def split_types(types: Column) -> Column:
    return F.when(F.coalesce(types, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(types, r"\|"))


def abbreviated(label: Column, longest: int = 20) -> Column:
    return F.when(F.length(label) <= longest, label).otherwise(F.concat(F.substring(label, 1, longest - 3), F.lit("...")))


def percent(part: Column) -> Column:
    return F.format_string("%.2f%%", part * 100)


def experiment_name(experiment_id: Column) -> Column:
    """All before the last point."""
    n = F.length(experiment_id) - F.length(F.substring_index(experiment_id, ".", -1)) - 1
    return F.when(n < 0, F.lit("")).otherwise(F.substr(experiment_id, F.lit(1), n))


def benchmark_name(experiment_id: Column) -> Column:
    """All behind the last point."""
    return F.substring_index(experiment_id, ".", -1)


def is_unknown(entity: Column) -> Column:
    return entity.isin(*UNKNOWN_ENTITIES)


def first_letter_is_upper(text: Column) -> Column:
    return F.rlike(F.regexp_extract(text, r"\p{L}", 0), F.lit(r"\p{Lu}"))


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    """Array of (number, start, end, paragraph): pieces between separators and their offsets."""
    parts = F.split(text, separator.replace("\n", "\\n"))
    step = len(separator)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    spans = F.aggregate(
        parts,
        state,
        lambda a, p: F.struct(
            (a["at"] + F.length(p) + step).alias("at"),
            F.array_append(a["out"], F.struct(a["at"].alias("start"), (a["at"] + F.length(p)).alias("end"))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.transform(spans, lambda s, i: F.struct(i.alias("number"), s["start"].alias("start"), s["end"].alias("end"), F.get(parts, i).alias("paragraph")))


BLOCK = 32


def with_starts(frame: DataFrame, lengths: str, name: str) -> DataFrame:
    """Add array ``name``: for each element of the array of numbers ``lengths`` the sum of those before it.

    Sums of blocks come first, so the work is near linear in long texts; a fold that appends would copy its result at each step.
    """
    size, add = F.size(lengths), lambda a, x: a + x
    total = lambda array, first, n: F.aggregate(F.slice(array, first, n), F.lit(0), add)
    sums = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int")), lambda b: total(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    frame = frame.withColumn("_sums", F.when(size > 0, sums))
    frame = frame.withColumn("_before", F.transform("_sums", lambda _, b: total("_sums", F.lit(1), b)))

    def start(_, k):
        b = F.floor(k / BLOCK).cast("int")  # _before is named twice, so that it stays a column of its own and is not built anew for each element
        return F.when(k % BLOCK == 0, F.get("_before", b)).otherwise(F.get("_before", b) + total(lengths, b * BLOCK + 1, k - b * BLOCK))

    return frame.withColumn(name, F.when(size > 0, F.transform(lengths, start)).otherwise(F.array().cast("array<int>"))).drop("_sums", "_before")


def clean_export_line(line: Column) -> Column:
    """Cells of a query-service export: entity addresses to ids, language tags, integer types and brackets off."""
    out = F.regexp_replace(line, r"<http://www\.wikidata\.org/entity/(Q[0-9]+)>", "$1")
    out = F.regexp_replace(out, r'"@en', '"')
    out = F.regexp_replace(out, r'"([0-9]+)"\^\^<http://www\.w3\.org/2001/XMLSchema#(?:int|integer|decimal)>', "$1")
    out = F.regexp_replace(out, r"<(https?://[^>]*)>", "$1")
    return F.replace(out, F.lit('"'), F.lit(""))


def redirect_target(line: Column) -> Column:
    """Target of a #REDIRECT line, or null."""
    target = F.regexp_extract(line, r"(?is)#REDIRECT.*?\[\[(.*?)\]\]", 1)
    return F.when(target != "", F.replace(target, F.lit("_"), F.lit(" ")))
