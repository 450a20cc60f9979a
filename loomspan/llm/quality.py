"""Quality rules with adaptive thresholds from mergeable quantile sketches (native).

Each document gets a few integer metrics. A sketch is a histogram over log-scaled integer buckets
(relative error at most 1/64) of the documents that pass the base rules: two sketches merge by adding counts,
so the sketch of each (lang, source, metric) is one ``groupBy().count()`` with map-side combine and never
holds more than some thousand buckets a group, and those of a language and of the corpus are sums of it.

A fence is a quantile of the sketch plus a multiple of the distance between two quantiles (``RULES``): the
middle half for metrics that every text has, which up to a quarter of junk does not move; the 99th
percentile for metrics that are zero in most texts. The fence of a (lang, source) with n documents is
shrunk towards that of its language, and that towards the corpus, with the weight of PRIOR documents, so that
small groups lean on the larger ones. GUARDS lie far outside and hold each fence, before it is shrunk, only where a
group is degenerate (all texts alike, or two kinds of texts in like shares). Documents are filtered by joining the fences.

Defined results: a null or blank text has no words and fails the base rules; null lang or source
form groups of their own; repeated rows are judged alike and count as often as they occur; an empty
table gives an empty result; other columns of the input, also those named like the metrics, are
carried unread in the struct ``row`` (only if ``carry``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WS_CHARS, join_small, materialize, words_of

WINDOW = 8
MARKS = "#*$%&|<>.,;:!?"
#: metric: (lower and upper percentile, distances between them that a fence is away, least distance as a part of
#: the median, or 0). Rates are in thousandths, letters a word in hundredths.
RULES = {
    "mark_rate": (25, 75, 8, 8),
    "echo_rate": (25, 75, 10, 2),
    "word_length": (25, 75, 6, 32),
    "repeat_rate": (50, 99, 1, 0),
    "dup_line_rate": (50, 99, 1, 0),
}
#: Outer limits of the upper fences, and of the lower fence that word_length has too.
GUARDS = {"mark_rate": (40, 300), "echo_rate": (30, 500), "word_length": (300, 4000), "repeat_rate": (80, 300), "dup_line_rate": (120, 900)}
LOWER, LOWER_GUARD = "word_length", (50, 480)
PRIOR = 200
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(frame: DataFrame) -> DataFrame:
    """Add n_repeat_words: words in WINDOW-word windows that occur twice or more in ``_words``; and n_echoes: words
    equal to the one before.

    Windows are compared by 64-bit hash. Only documents whose windows are not all distinct are sorted;
    work is n log n in the words of a document.
    """
    at = lambda a, i: F.get(a, i)
    frame = frame.withColumn("_wh", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_wh")
    same = F.filter(F.sequence(F.lit(1), n - 1), lambda i: at(F.col("_wh"), i) == at(F.col("_wh"), i - 1))
    frame = frame.withColumn("n_echoes", F.when(n > 1, F.size(same)).otherwise(0).cast("long"))
    window = F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(*[at(F.col("_wh"), i + k) for k in range(WINDOW)]),
    )
    frame = frame.withColumn("_h", F.when(n > WINDOW, window)).drop("_wh")
    frame = frame.withColumn("_same", F.coalesce(F.size(F.array_distinct("_h")) < F.size("_h"), F.lit(False)))
    pairs = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    frame = frame.withColumn("_p", F.when(F.col("_same"), pairs)).drop("_h")
    p = F.col("_p")
    twice = F.filter(
        F.sequence(F.lit(0), F.size(p) - 1),
        lambda k: F.coalesce(at(p, k)["h"] == at(p, k - 1)["h"], F.lit(False))
        | F.coalesce(at(p, k)["h"] == at(p, k + 1)["h"], F.lit(False)),
    )
    frame = frame.withColumn("_at", F.when(F.col("_same"), F.sort_array(F.transform(twice, lambda k: at(p, k)["i"])))).drop("_p")
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    return frame.withColumn("n_repeat_words", F.when(F.col("_same"), covered).otherwise(0).cast("long")).drop("_at", "_same")


def measure(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, lang, source and the metrics of every whole text; with ``carry`` the input row as ``row``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    frame = docs.select(
        "doc_id", "lang", "source", *([F.struct("*").alias("row")] if carry else []), text.alias("_text")
    )
    frame = frame.withColumn("_words", words_of(F.col("_text")))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")
    frame = frame.select(
        *[c for c in frame.columns if c != "_text"],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", WS_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length("_text") - F.length(F.translate("_text", MARKS, ""))).cast("long").alias("n_marks"),
        lines.alias("_lines"),
    )
    frame = frame.withColumn("n_lines", F.size("_lines").cast("long"))
    frame = frame.withColumn("n_dup_lines", (F.col("n_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    return _repeat_words(frame).drop("_words")


def _rates() -> dict[str, Column]:
    """The judged metrics as whole numbers (integer division)."""
    rate = lambda a, b, x: F.expr(f"({a} * {x}) div greatest({b}, 1)")
    return {
        "mark_rate": rate("n_marks", "word_chars", 1000),
        "echo_rate": rate("n_echoes", "n_words", 1000),
        "word_length": rate("word_chars", "n_words", 100),
        "repeat_rate": rate("n_repeat_words", "n_words", 1000),
        "dup_line_rate": rate("n_dup_lines", "n_lines", 1000),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n: the histogram sketch of each group of ``measured`` (a written table); merge by summing n."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("v")) for k, v in _rates().items()])
    rows = measured.where(~base_failed()).select("lang", "source", F.explode(pairs).alias("x"))
    v, bits = F.col("x.v"), F.greatest(F.length(F.bin("x.v")) - 7, F.lit(0))
    bucket = F.expr("shiftleft(shiftright(v, bits), bits)")
    return (
        rows.select("lang", "source", F.col("x.metric").alias("metric"), v.alias("v"), bits.alias("bits"))
        .select("lang", "source", "metric", bucket.alias("bucket"))
        .groupBy("lang", "source", "metric", "bucket")
        .agg(F.count("*").alias("n"))
    )


def _own_fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, n (documents), up, low: the fences that the sketches of each group give by themselves."""
    group = Window.partitionBy(*keys, "metric")
    run = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.withColumn("cum", F.sum("n").over(run)).withColumn("total", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("cum") * 100 >= F.col("total") * q, F.col("bucket"))).alias(f"q{q}")
    q = ranked.groupBy(*keys, "metric").agg(F.max("total").alias("n"), *[at(x) for x in (25, 50, 75, 99)])
    up = low = F.lit(None).cast("double")
    held = lambda x, lo, hi: F.least(F.greatest(x.cast("double"), F.lit(float(lo))), F.lit(float(hi)))
    for k, (a, b, times, part) in RULES.items():
        least = F.expr(f"q50 div {part}") if part else F.lit(0)
        away = times * F.greatest(F.col(f"q{b}") - F.col(f"q{a}"), least)
        up = F.when(F.col("metric") == k, held(F.col(f"q{b}") + away, *GUARDS[k])).otherwise(up)
        if k == LOWER:
            low = F.when(F.col("metric") == k, held(F.col(f"q{a}") - away, *LOWER_GUARD)).otherwise(low)
    return q.select(*keys, "metric", "n", up.alias("up"), low.alias("low"))


def fences(sketch: DataFrame) -> DataFrame:
    """One row a (lang, source): the upper fence of each metric, and min_word_length."""
    merged = lambda keys: sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    named = lambda frame, to: frame.select(*[F.col(c).alias(f"{to}_{c}") for c in frame.columns])
    language, corpus = named(_own_fences(merged(["lang"]), ["lang"]), "l"), named(_own_fences(merged([]), []), "c")
    rows = _own_fences(sketch, ["lang", "source"])
    rows = rows.join(language, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("metric") == F.col("l_metric")))
    rows = rows.join(F.broadcast(corpus), F.col("metric") == F.col("c_metric"))  # a row a metric
    shrunk = lambda n, own, wide: (n * own + PRIOR * wide) / (n + PRIOR)
    pooled = lambda x: shrunk(F.col("n"), F.col(x), shrunk(F.col("l_n"), F.col(f"l_{x}"), F.col(f"c_{x}")))
    of = lambda k, x: F.max(F.when(F.col("metric") == k, pooled(x)))
    return rows.groupBy("lang", "source").agg(*[of(k, "up").alias(f"max_{k}") for k in RULES], of(LOWER, "low").alias(f"min_{LOWER}"))


def judge(measured: DataFrame) -> DataFrame:
    """Add base_failed and kept to measured rows (a materialized table: it is read twice)."""
    limits = materialize(fences(materialize(sketches(measured), "sketches")), "fences")
    out = join_small(measured, limits, ["lang", "source"], limits.count())
    fine = ~base_failed()
    for k, v in _rates().items():
        fine = fine & F.coalesce(v <= F.col(f"max_{k}"), F.lit(True))
    fine = fine & F.coalesce(_rates()[LOWER] >= F.col(f"min_{LOWER}"), F.lit(True))
    return out.select(*measured.columns, base_failed().alias("base_failed"), fine.alias("kept"))


def quality_rules(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Metrics and verdict of every document; with ``carry`` the input row as struct ``row``."""
    return judge(materialize(measure(docs, carry), "quality"))
