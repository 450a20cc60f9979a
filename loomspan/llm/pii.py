"""Personal data: patterns propose spans, checksums confirm them, context words adjust scores (native).

Kinds: email, ip, card (Luhn) and phone follow fixed rules and always stay once confirmed; iban (mod 97)
and ssn are added by the method. Each span has the score of its kind; context words within CONTEXT characters before
or behind raise it, words that speak of other numbers lower it, and added spans under THRESHOLD are dropped: an ssn
needs a word for it, an iban stays unless the words around speak against it and none for it.

An iban is tried at each head (two letters, two digits) that starts a token: the longest prefix of the characters
behind it that ends with a token and passes mod 97 is the span. Spans of two heads can overlap; mask joins them.

Offsets are code points, end exclusive. They come from splitting the text at the pattern and summing the
lengths of pieces and matches, in blocks, so the work is near linear in the number of matches.
Patterns are possessive or guarded by a look-behind where that gives the same matches: no quadratic
backtracking on long runs.

Defined results: a null text is empty; empty texts have no spans; repeated rows are scanned alike; an
empty table gives an empty result; other columns are carried unread in ``row`` (only if ``carry``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
# The patterns.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Only the head is consumed, so a false head hides no number behind it; group 1 is the longest candidate.
    "iban": r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9]))[A-Z]{2}[0-9]{2}",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without the needle can't match: a cheap test before the pattern is run.
NEEDLES = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "ssn": "-"}
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
# Context words that raise the score of a kind.
CONTEXT_WORDS = {
    "email": "mail|contact|write|address",
    "ip": "ip|host|server|address",
    "card": "card|visa|credit|payment|number",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social|security|tax",
}
# Context words that lower it.
OTHER_WORDS = "isbn|serial|version|checksum|hash|sample|example"
CONTEXT, RAISE, LOWER, THRESHOLD = 40, 0.3, 0.3, 0.6
_BLOCK = 64


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether the digits of a string pass the Luhn check."""
    d = F.reverse(_digits(s))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substr(d, i, F.lit(1)).cast("int")).otherwise(
            F.substr(d, i, F.lit(1)).cast("int") * 2 - F.when(F.substr(d, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)
        ),
    )
    return (F.length(d) > 0) & (total % 10 == 0)


def mod97(s: Column) -> Column:
    """Whether an account number passes the mod-97 check (letters count 10 to 35, first four moved to the end)."""
    c = F.upper(F.replace(s, F.lit(" "), F.lit("")))
    turned = F.concat(F.substr(c, F.lit(5)), F.substr(c, F.lit(1), F.lit(4)))
    rest = F.aggregate(
        F.sequence(F.lit(1), F.length(turned)),
        F.lit(0),
        lambda acc, i: F.when(
            F.ascii(F.substr(turned, i, F.lit(1))) >= 65, (acc * 100 + F.ascii(F.substr(turned, i, F.lit(1))) - 55) % 97
        ).otherwise((acc * 10 + F.ascii(F.substr(turned, i, F.lit(1))) - 48) % 97),
    )
    return rest == 1


def _account(candidate: Column) -> Column:
    """The longest prefix of a candidate that ends with a token, has 15 characters at least and passes mod 97, or null."""
    tokens = F.split(candidate, " ")
    prefixes = F.transform(F.sequence(F.size(tokens), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(tokens, F.lit(1), k), " "))
    return F.get(F.filter(prefixes, lambda p: (F.length(F.replace(p, F.lit(" "), F.lit(""))) >= 15) & mod97(p)), F.lit(0))


def _confirmed(kind: str, s: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_extract(p, "^0*([0-9]{1,3})$", 1)
        return F.forall(F.split(s, "\\."), lambda p: (part(p) != "") & (F.coalesce(F.try_to_number(part(p), F.lit("999")), F.lit(999)) <= 255))
    if kind == "card":
        n = F.length(_digits(s))
        return F.when(n.between(16, 19), luhn(s)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(s)).between(8, 15)
    if kind == "iban":
        return s.isNotNull()
    return F.lit(True)


def _matches(frame: DataFrame, kind: str) -> DataFrame:
    """Add column ``kind``: array of (start, end, hit), in order, confirmed."""
    pattern, needle = PATTERNS[kind], NEEDLES[kind]
    none = F.array().cast("array<string>")
    hits = F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))
    frame = frame.withColumn("_m", F.when(F.contains("_text", F.lit(needle)), hits).otherwise(none) if needle else hits)
    n = F.size("_m")
    frame = frame.withColumn("_pieces", F.when(n > 0, F.split("_text", pattern, -1)))
    piece, hit = (lambda k: F.length(F.get("_pieces", k))), (lambda k: F.length(F.get("_m", k)))
    index = F.sequence(F.lit(0), n - 1)
    frame = frame.withColumn("_len", F.when(n > 0, F.transform(index, lambda k: piece(k) + hit(k)))).withColumn("_gap", F.when(n > 0, F.transform(index, piece))).drop("_pieces")
    add = lambda a, b: a + b
    blocks = F.transform(F.sequence(F.lit(0), ((n - 1) / _BLOCK).cast("int")), lambda b: F.aggregate(F.slice("_len", b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), add))
    frame = frame.withColumn("_sums", F.when(n > 0, blocks))
    before = F.transform("_sums", lambda _, b: F.aggregate(F.slice("_sums", F.lit(1), b), F.lit(0), add))
    frame = frame.withColumn("_before", F.when(n > 0, before)).drop("_sums")
    found = F.col("_m")
    if kind == "iban":
        wide = F.regexp_extract_all("_text", F.lit(pattern), F.lit(1))
        frame, found = frame.withColumn("_wide", F.when(n > 0, F.transform(wide, _account))), F.col("_wide")

    def span(k: Column) -> Column:
        b = (k / _BLOCK).cast("int")
        start = F.get("_before", b) + F.aggregate(F.slice("_len", b * _BLOCK + 1, k - b * _BLOCK), F.lit(0), add) + F.get("_gap", k)
        return F.struct(start.alias("start"), (start + F.length(F.get(found, k))).alias("end"), F.get(found, k).alias("hit"))

    frame = frame.withColumn("_spans", F.when(n > 0, F.transform(index, span))).drop("_len", "_gap", "_before", "_m", "_wide")
    sure = F.filter("_spans", lambda x: _confirmed(kind, x["hit"]))
    return frame.withColumn(f"_{kind}", F.when(F.size("_spans") > 0, sure)).drop("_spans")


def _scored(kind: str, text: Column) -> Column:
    """Spans as (kind, start, end, score); those of added kinds under THRESHOLD are dropped."""

    def one(x: Column) -> Column:
        lo = F.greatest(x["start"] - CONTEXT, F.lit(0))
        near = F.concat(F.substr(text, lo + 1, x["start"] - lo), F.lit(" "), F.substr(text, x["end"] + 1, F.lit(CONTEXT)))
        raised = F.when(F.rlike(near, F.lit(f"(?i)(?<![a-z])(?:{CONTEXT_WORDS[kind]})")), RAISE).otherwise(0.0)
        lowered = F.when(F.rlike(near, F.lit(f"(?i)(?<![a-z])(?:{OTHER_WORDS})")), LOWER).otherwise(0.0)
        score = F.round(F.least(F.lit(SCORES[kind]) + raised - lowered, F.lit(1.0)), 2)
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score.alias("score"))

    spans = F.transform(f"_{kind}", one)
    return spans if kind in BASE_KINDS else F.filter(spans, lambda x: x["score"] >= THRESHOLD)


def find(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, text, spans (kind, start, end, score; by kind as in KINDS, then start)[, row]."""
    frame = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"), *([F.struct("*").alias("row")] if carry else []))
    for kind in KINDS:
        frame = _matches(frame, kind)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    found = [F.when(F.size(f"_{k}") > 0, _scored(k, F.col("_text"))).otherwise(none) for k in KINDS]
    return frame.select("doc_id", F.col("_text").alias("text"), *(["row"] if carry else []), F.concat(*found).alias("spans"))


def mask(found: DataFrame) -> DataFrame:
    """Add ``masked``: the text with each span replaced by <KIND>; overlapping spans become one, named by the first."""
    ordered = F.sort_array(F.transform("spans", lambda x: F.struct(x["start"].alias("s"), (-x["end"]).alias("e"), x["kind"].alias("k"))))
    frame = found.withColumn("_o", F.when(F.size("spans") > 0, ordered))
    run = "struct<out:array<struct<s:int,e:int,k:string> >,last:struct<s:int,e:int,k:string> >"
    start = F.expr(f"cast(null as {run})")

    def step(a: Column, x: Column) -> Column:
        new = F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["k"].alias("k"))
        last, empty = a["last"], F.array().cast("array<struct<s:int,e:int,k:string>>")
        grown = F.struct(last["s"].alias("s"), F.greatest(last["e"], -x["e"]).alias("e"), last["k"].alias("k"))
        out = F.coalesce(a["out"], empty)
        return (
            F.when(a["last"].isNull(), F.struct(empty.alias("out"), new.alias("last")))
            .when(x["s"] < last["e"], F.struct(out.alias("out"), grown.alias("last")))
            .otherwise(F.struct(F.concat(out, F.array(last)).alias("out"), new.alias("last")))
        )

    frame = frame.withColumn("_r", F.aggregate("_o", start, step, lambda a: F.concat(a["out"], F.array(a["last"]))))
    r = F.col("_r")
    part = lambda x, i: F.concat(
        F.substr(F.col("text"), F.coalesce(F.get(r, i - 1)["e"], F.lit(0)) + 1, x["s"] - F.coalesce(F.get(r, i - 1)["e"], F.lit(0))),
        F.lit("<"),
        F.upper(x["k"]),
        F.lit(">"),
    )
    tail = F.substr(F.col("text"), F.element_at(r, -1)["e"] + 1)
    masked = F.concat(F.array_join(F.transform(r, part), ""), tail)
    return frame.withColumn("masked", F.when(F.size("spans") > 0, masked).otherwise(F.col("text"))).drop("_o", "_r")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, hash of the base spans, all spans and their scores in the same order, of each document."""
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda x: x["score"].cast("string")), ",").alias("scores"))
