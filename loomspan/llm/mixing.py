"""Mixing sources to target weights by Pareto order sampling (native).

Targets: the sources, in code point order with null last, weigh 3, 1, 2, repeating, and share
``total`` of all words; a target stops at ``cap`` times its source's words and the excess is shared
again by weight, until none is above.

Documents of a source have unequal odds: a document is wanted m = min(cap, c * w) times, where its weight w is the
number of binary digits of its size (a text of 1,000 words is wanted about twice as often as one of 30), and c is set
so that the words wanted add up to the target. Every document gets floor(m) certain whole copies; of the rest, with
inclusion odds p / (1 - p), p = m - floor(m), a Pareto sample is taken: each document draws random odds u / (1 - u),
divides them by its inclusion odds, and the lowest of these ranks are taken up to the size that is left, counted in
words: the document across which the size is met is taken if that comes nearer. As there are at most 64 weights,
c comes from one row a source and weight.

The ranks are cut without sorting a source in one task: words are summed over ``buckets`` rank buckets
a source, the bucket that holds the cut is found from these sums, and only its documents are ordered.

Defined results: null and blank texts have size 0; rows that repeat a doc_id with another text draw a number of their
own, equal rows share it and are ordered as they come, so reruns agree; an empty table gives an empty result; other
columns are carried unread in the struct ``row`` (only if ``carry``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ordinal import with_ordinal
from ._common import join_small, materialize, words_of

WEIGHTS = (3, 1, 2)
TOTAL, CAP = 1.5, 2.0
BUCKETS = 4096
SEED = "mix-2"


def _uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1) from the MD5 of seed, id and text: 52 bits, the same in any SQL engine."""
    own = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), own).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """source, source_size (one row a source) -> with target.

    Sources are numbered by a distributed sort; the water level is found by sums over all sources, repeated until
    no further source is above its cap.
    """
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_n") % n + 1).cast("int"))
    rows = with_ordinal(sizes.select("source", "source_size"), "_n", F.col("source").asc_nulls_last())
    rows = materialize(rows.select("source", "source_size", w.alias("_w"), (F.col("source_size") * F.lit(float(cap))).alias("_cap")), "sources")
    goal = float(total) * (rows.agg(F.sum("source_size")).first()[0] or 0)
    capped, level = -1, 0.0
    while True:
        over = F.lit(level) * F.col("_w") > F.col("_cap")
        r = rows.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("_cap"))), F.lit(0.0)), F.sum(F.when(~over, F.col("_w")))).first()
        if r[0] == capped or not r[2]:
            break
        capped, level = r[0], (goal - r[1]) / r[2]
    return rows.select("source", "source_size", F.when(over, F.col("_cap")).otherwise(F.lit(level) * F.col("_w")).alias("target"))


def _sized(docs: DataFrame, carry: bool, seed: str) -> DataFrame:
    row = [F.struct("*").alias("row")] if carry else []
    size = F.size(words_of(F.col("text"))).cast("long")
    sized = docs.select("doc_id", "source", *row, size.alias("size"), _uniform(F.col("doc_id"), F.col("text"), seed).alias("_u"))
    return sized.withColumn("_w", F.length(F.bin("size")))


def wanted(classes: DataFrame, cap: float = CAP) -> DataFrame:
    """source, _w, s (words of the class), source_size, target -> with _certain, _p, _rest: min(cap, c * _w) split in
    whole copies and a rest, and the words of the source that its rests add up to."""
    down = Window.partitionBy("source").orderBy(F.desc("_w"))
    above = F.coalesce(F.sum("s").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tail = F.sum(F.col("s") * F.col("_w")).over(down.rowsBetween(0, Window.unboundedFollowing))
    c = F.when(tail > 0, (F.col("target") - F.lit(float(cap)) * above) / tail)
    whole = Window.partitionBy("source")
    out = classes.withColumn("_c", c)
    out = out.withColumn("_c", F.max(F.when(F.col("_c") * F.col("_w") <= cap, F.struct("_w", "_c"))).over(whole)["_c"])
    m = F.when(F.col("source_size") > 0, F.coalesce(F.least(F.lit(float(cap)), F.col("_c") * F.col("_w")), F.lit(float(cap)))).otherwise(0.0)
    out = out.withColumn("_m", m).withColumn("_certain", F.floor("_m").cast("int")).withColumn("_p", F.col("_m") - F.floor("_m"))
    rest = F.col("target") - F.sum(F.col("_certain") * F.col("s")).over(whole)
    return out.withColumn("_rest", rest).drop("_c", "_m", "s")


def _ranked(sized: DataFrame, plan: DataFrame, rows: int, buckets: int) -> DataFrame:
    """Join the plan of each source and weight; add the Pareto rank and its bucket."""
    out = join_small(sized, plan, ["source", "_w"], rows)
    q = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    out = out.withColumn("_q", F.when(F.col("_p") > 0, q))
    # the cut is near rank 1, the middle of the buckets; none there holds more than some 1/buckets of a source
    return out.withColumn("_b", F.floor(F.col("_q") / (1 + F.col("_q")) * buckets).cast("int"))


def mix(docs: DataFrame, carry: bool = False, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, p (inclusion probability beyond certain copies), copies[, row]."""
    narrow = materialize(_sized(docs, False, seed), "sizes")
    classes = materialize(narrow.groupBy("source", "_w").agg(F.sum("size").alias("s")), "weights")
    aims = targets(classes.groupBy("source").agg(F.sum("s").alias("source_size")), weights, total, cap).withColumnRenamed("source", "_s")
    plan = materialize(wanted(classes.join(aims, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), cap), "plan")
    rows = plan.count()
    sums = _ranked(narrow, plan, rows, buckets).where("_q is not null").groupBy("source", "_b").agg(F.sum("size").alias("s"), F.first("_rest").alias("_rest"))
    upto = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cum = sums.withColumn("_after", F.sum("s").over(upto)).withColumn("_before", F.col("_after") - F.col("s"))
    cut = cum.where("_before <= _rest and _after > _rest").groupBy("source").agg(F.min_by("_b", "_b").alias("_cut"), F.min("_before").alias("_before"))
    cuts = materialize(plan.join(cut.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "cuts")
    sized = _sized(docs, True, seed) if carry else narrow
    ranked = _ranked(sized, cuts, rows, buckets)
    is_cut = F.coalesce(F.col("_b") == F.col("_cut"), F.lit(False))
    names = ["doc_id", "source", "size", "source_size", "target", F.col("_p").alias("p"), *(["row"] if carry else [])]
    # without a cut, all that is ranked fits
    clear = ranked.where(~is_cut).withColumn("copies", F.col("_certain") + F.coalesce((F.col("_cut").isNull() | (F.col("_b") < F.col("_cut"))) & F.col("_q").isNotNull(), F.lit(False)).cast("int"))
    order = Window.partitionBy("source").orderBy("_q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("_before") + F.sum("size").over(order) - F.col("size") / 2
    edge = ranked.where(is_cut).withColumn("copies", F.col("_certain") + (middle <= F.col("_rest")).cast("int"))
    return clear.select(*names, "copies").unionByName(edge.select(*names, "copies"))
