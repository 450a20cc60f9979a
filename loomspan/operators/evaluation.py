"""Evaluation: cases from gold labels and predictions, evaluation types, metrics and error categories.

Modes: REQUIRED counts all gold labels; IGNORED leaves unknown gold entities (and unknown predictions) out.
Ratios are 0 where their denominator is 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..storage import cut
from . import spans

MODES = ("IGNORED", "REQUIRED")
# English pronouns that refer to entities.
PRONOUNS = ("he", "she", "it", "they", "him", "her", "them", "his", "its", "their", "hers", "theirs", "himself", "herself", "itself", "themselves", "who", "whom", "whose", "which", "this", "that")


def cases(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """One case for each distinct span of labels and predictions of an article.

    labels: article_id, start, end, entity_id, ...; predictions: the same with candidates etc. The sides come as
    structs ``gold`` and ``predicted`` (null where a side is missing).
    """
    keys = ["article_id", "start", "end"]
    g = labels.select(*keys, F.struct(*[c for c in labels.columns if c not in keys]).alias("gold"))
    p = predictions.select(*keys, F.struct(*[c for c in predictions.columns if c not in keys]).alias("predicted"))
    return g.join(p, keys, "full_outer")


def eval_types(case: DataFrame) -> DataFrame:
    """Add linking (array of TP, FP, FN) for each mode: columns required and ignored; and ner."""
    gold, pred = F.col("gold.entity_id"), F.col("predicted.entity_id")
    some = lambda *pairs: F.filter(F.array(*[F.when(c, F.lit(v)) for v, c in pairs]), lambda x: x.isNotNull())
    has_gold, has_pred = F.col("gold").isNotNull(), F.col("predicted").isNotNull()
    hit = F.coalesce(gold == pred, F.lit(False))
    known_gold, known_pred = has_gold & ~F.coalesce(tx.is_unknown(gold), F.lit(True)), has_pred & ~F.coalesce(tx.is_unknown(pred), F.lit(True))
    required = some(("TP", hit), ("FN", has_gold & ~hit), ("FP", has_pred & ~hit))
    ignored = some(("TP", hit & known_gold), ("FN", known_gold & ~hit), ("FP", known_pred & ~hit))
    ner = some(("TP", has_gold & has_pred), ("FN", has_gold & ~has_pred), ("FP", has_pred & ~has_gold))
    ner_ignored = some(("TP", known_gold & has_pred), ("FN", known_gold & ~has_pred), ("FP", known_pred & ~known_gold))
    return case.withColumns({"required": required, "ignored": ignored, "ner_required": ner, "ner_ignored": ner_ignored})


def mention_type(text: Column, gold_entity: Column, coref: Column) -> Column:
    """Group of a mention by its first letter, whether it is a pronoun or a coreference, and whether its entity is known."""
    pronoun = F.lower(text).isin(*PRONOUNS)
    return (
        F.when(F.coalesce(tx.is_unknown(gold_entity), F.lit(False)), "ENTITY_UNKNOWN")
        .when(pronoun, "COREF_PRONOMINAL")
        .when(F.coalesce(coref, F.lit(False)), "COREF_NOMINAL")
        .when(tx.first_letter_is_upper(text), "ENTITY_NAMED")
        .otherwise("ENTITY_NON_NAMED")
    )


def mention_groups(kind: Column) -> Column:
    """all, entity or coref, and the mention type itself."""
    return F.array(F.lit("all"), F.when(F.startswith(kind, F.lit("ENTITY")), "entity").otherwise("coref"), F.lower(kind))


def with_ratios(counts: DataFrame) -> DataFrame:
    """tp, fp, fn -> ground_truth, precision, recall, f1."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = counts.withColumn("ground_truth", F.col("tp") + F.col("fn")).withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def counted(typed: DataFrame, types: str, group: list[str], factor: str | None = None) -> DataFrame:
    """tp, fp, fn by group from an array column of evaluation types."""
    weight = F.col(factor) if factor else F.lit(1)
    one = lambda t: F.sum(F.when(F.array_contains(types, t), weight).otherwise(0)).cast("long").alias(t.lower())
    return typed.groupBy(*group).agg(one("TP"), one("FP"), one("FN"))


def by_mode(typed: DataFrame, what: str = "") -> DataFrame:
    """One row a case and mode: mode, types."""
    pair = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"{what}{m.lower()}").alias("types")) for m in MODES])
    return typed.select("*", F.explode(pair).alias("_m")).select(*typed.columns, "_m.mode", "_m.types")


def mention_type_metrics(typed: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Metrics of all, entity, coref and each mention type (column mention_type), by mode."""
    rows = by_mode(typed).withColumn("category", F.explode(mention_groups(F.col("mention_type"))))
    return with_ratios(counted(rows, "types", [*(group or []), "mode", "category"]))


def ner_metrics(typed: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Recognition metrics: coreference cases are left out."""
    rows = by_mode(typed.where(F.startswith("mention_type", F.lit("ENTITY"))), "ner_")
    return with_ratios(counted(rows, "types", [*(group or []), "mode"]))


def entity_type_metrics(typed: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Metrics of each whitelisted type and OTHER, also those without cases: TP and FN by gold type, FP by predicted type.

    typed needs gold.type and predicted.type (|-joined).
    """
    rows = by_mode(typed.where(F.startswith("mention_type", F.lit("ENTITY"))))
    side = lambda t, keep: rows.select("mode", F.explode(tx.split_types(F.col(t))).alias("type_id"), F.filter("types", lambda x: x.isin(*keep)).alias("types"))
    counts = counted(side("gold.type", ("TP", "FN")).unionByName(side("predicted.type", ("FP",))), "types", ["mode", "type_id"])
    kinds = whitelist.select("type_id").unionByName(typed.sparkSession.createDataFrame([("OTHER",)], "type_id string")).distinct()
    kinds = kinds.select("type_id", F.explode(F.array(*map(F.lit, MODES))).alias("mode"))
    full = kinds.join(counts, ["mode", "type_id"], "left").na.fill(0, ["tp", "fp", "fn"])
    return with_ratios(full)


def recognition_errors(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Kinds of missed gold mentions and of false detections: article_id, start, end, side, category.

    Missed: lowercased, partially_included, partial_overlap or other. False: lowercased, groundtruth_unknown or other,
    and wrong_span besides, where a gold mention of the same entity overlaps. Both need text and entity_id.
    """
    keys = ["article_id", "start", "end"]
    lower = tx.is_all_lower(F.col("text"))

    def alone(rows: DataFrame, others: DataFrame) -> DataFrame:
        """Rows whose span the others lack, each with other null, and again with each of the others that it overlaps."""
        o = others.select(*keys, "entity_id")
        own = rows.select(*keys, "text", "entity_id").join(o.select(*keys), keys, "left_anti")
        pairs = spans.touching(own, o)
        return own.withColumn("other", F.lit(None).cast(pairs.schema["other"].dataType)).unionByName(pairs)

    missed = alone(labels, predictions).groupBy(*keys, "text").agg(
        F.count("other").alias("n"), F.coalesce(F.bool_or((F.col("other.start") >= F.col("start")) & (F.col("other.end") <= F.col("end"))), F.lit(False)).alias("within")
    )
    missed = missed.select(*keys, F.lit("ner_fn").alias("side"), F.when(lower, "lowercased").when(F.col("within") & F.contains("text", F.lit(" ")), "partially_included").when(F.col("n") > 0, "partial_overlap").otherwise("other").alias("category"))
    false = alone(predictions, labels).groupBy(*keys, "text", "entity_id").agg(
        F.count("other").alias("n"),
        F.coalesce(F.bool_or(tx.is_unknown(F.col("other.entity_id"))), F.lit(False)).alias("unknown"),
        F.coalesce(F.bool_or(F.col("other.entity_id") == F.col("entity_id")), F.lit(False)).alias("same"),
    )
    kinds = F.array_compact(F.array(F.when(lower & (F.col("n") == 0), "lowercased").when(~lower & F.col("unknown"), "groundtruth_unknown").otherwise("other"), F.when(F.col("same"), "wrong_span")))
    return missed.unionByName(false.select(*keys, F.lit("ner_fp").alias("side"), F.explode(kinds).alias("category")))


def recognition_totals(labels: DataFrame, predictions: DataFrame, words: DataFrame) -> DataFrame:
    """side, category, total: what the kinds of recognition_errors are counted against. words (text): those of the evaluated texts."""
    lower = tx.is_all_lower(F.col("text"))

    def table(rows: DataFrame, side: str, **kinds: Column) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(k).alias("category"), F.count_if(c).alias("total")) for k, c in kinds.items()])
        return rows.agg(cells.alias("x")).select(F.lit(side).alias("side"), F.explode("x").alias("x")).select("side", "x.*")

    every, blank = F.lit(True), F.contains("text", F.lit(" "))
    out = table(labels, "ner_fn", all=every, lowercased=lower, partially_included=blank, partial_overlap=~lower, other=~lower)
    out = out.unionByName(table(labels, "ner_fp", groundtruth_unknown=~lower & tx.is_unknown(F.col("entity_id"))))
    return out.unionByName(table(words, "ner_fp", all=every, lowercased=lower, other=~lower)).unionByName(table(predictions, "ner_fp", wrong_span=every))


def disambiguation_errors(pairs: DataFrame) -> DataFrame:
    """category, errors, total over recognised mentions.

    pairs: text, gold, predicted, popular (entities), gold_name, gold_is_place, predicted_is_place, popular_is_place,
    gold_is_demonym_type, is_demonym, candidates (array).
    """
    wrong = F.col("gold") != F.col("predicted")
    c = lambda name: F.coalesce(F.col(name), F.lit(False))
    demonym = c("is_demonym")
    metonymy = c("popular_is_place") & ~c("gold_is_place")
    partial = F.coalesce(F.contains("gold_name", F.col("text")) & (F.col("gold_name") != F.col("text")), F.lit(False))
    rare = F.coalesce(F.col("popular") != F.col("gold"), F.lit(False))
    among = F.coalesce(F.array_contains("candidates", F.col("gold")), F.lit(False))
    multiple = (F.size("candidates") > 1) & among
    hits = {
        "all": (wrong, F.lit(True)),
        "demonym": (wrong & demonym & c("gold_is_demonym_type"), demonym),
        "metonymy": (wrong & metonymy & c("predicted_is_place"), metonymy),
        "partial_name": (wrong & partial, partial),
        "rare": (wrong & rare & F.coalesce(F.col("predicted") == F.col("popular"), F.lit(False)), rare),
        "wrong_candidates": (wrong & ~among, F.lit(True)),
        "multiple_candidates": (wrong & multiple, multiple),
    }
    none = ~(demonym | metonymy | partial | rare)
    hits["other"] = (wrong & none, none)
    counts = [F.struct(F.lit(k).alias("category"), F.count_if(e).alias("errors"), F.count_if(t).alias("total")) for k, (e, t) in hits.items()]
    return pairs.agg(F.array(*counts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def coreference_cascade(cases_: DataFrame) -> DataFrame:
    """category, errors, total of gold coreference mentions: undetected, wrong_mention_referenced, reference_wrongly_disambiguated.

    Booleans detected, right_mention, right_entity; each total is the one before less its errors.
    """
    n = F.count("*")
    lost = F.count_if(~F.col("detected"))
    astray = F.count_if(F.col("detected") & ~F.col("right_mention"))
    wrong = F.count_if(F.col("detected") & F.col("right_mention") & ~F.col("right_entity"))
    rows = [("undetected", lost, n), ("wrong_mention_referenced", astray, n - lost), ("reference_wrongly_disambiguated", wrong, n - lost - astray)]
    pack = F.array(*[F.struct(F.lit(k).alias("category"), e.alias("errors"), t.alias("total")) for k, e, t in rows])
    return cases_.agg(pack.alias("x")).select(F.explode("x").alias("x")).select("x.*")


def false_coreference_detections(false_positives: DataFrame) -> DataFrame:
    return false_positives.where(F.col("text").isin(*tx.PRONOUN_FALSE_DETECTIONS))


def undetected_hyperlinks(missed: DataFrame, hyperlinks: DataFrame) -> DataFrame:
    """Missed gold mentions whose span is that of a hyperlink."""
    return missed.join(hyperlinks.select("article_id", "start", "end").distinct(), ["article_id", "start", "end"], "left_semi")


def tag_counts(cases_: DataFrame, mode: str) -> DataFrame:
    """tag, n: error tags of stored cases (error_labels: mode -> tags); both spellings of one tag count alike."""
    tags = cases_.select(F.explode(F.coalesce(F.try_element_at("error_labels", F.lit(mode)), F.array().cast("array<string>"))).alias("tag"))
    same = F.when(F.col("tag") == "DISAMBIGUATION_OTHER_WRONG", "DISAMBIGUATION_WRONG_OTHER").otherwise(F.col("tag"))
    return tags.groupBy(same.alias("tag")).agg(F.count("*").alias("n"))


def root_labels(labels: DataFrame, levels: int = 16) -> DataFrame:
    """Add root (id of the topmost ancestor) to labels (article_id, id, parent), climbing one level a join."""
    up = labels.select(F.col("article_id").alias("_a"), F.col("id").alias("_i"), F.col("parent").alias("_p"))
    now = labels.withColumn("root", F.col("id")).withColumn("_up", F.col("parent"))
    for _ in range(levels):
        now = now.join(up, (F.col("article_id") == F.col("_a")) & (F.col("_up") == F.col("_i")), "left")
        now = cut(now.withColumn("root", F.coalesce("_i", "root")).withColumn("_up", F.col("_p")).drop("_a", "_i", "_p"))
        if now.where("_up is not null").isEmpty():
            return now.drop("_up")
    raise RuntimeError("labels are nested deeper than expected, or in a cycle")


def filter_labels(labels: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Labels whose root is kept: any type whitelisted or the entity unknown; a label without types goes, and with it those below.

    Goes down from the roots until a level is empty, however deep labels are nested: a label has one parent, so this ends.
    """
    allowed = [r.type_id for r in whitelist.select("type_id").distinct().collect()]  # a hand-written list
    types = tx.split_types(F.col("type"))
    fine = (F.size(types) > 0) & (F.arrays_overlap(types, F.array(*map(F.lit, allowed))) | tx.is_unknown(F.col("entity_id")))
    kept = labels.where(F.col("parent").isNull() & fine)
    out, front = [kept], kept
    while True:
        up = front.select(F.col("article_id").alias("_a"), F.col("id").alias("_i"))
        front = cut(labels.where(F.size(types) > 0).join(up, (F.col("article_id") == F.col("_a")) & (F.col("parent") == F.col("_i")), "left_semi"))
        if front.isEmpty():
            break
        out.append(front)
    return reduce(DataFrame.unionByName, out)


def filter_predictions(predictions: DataFrame, types: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Predictions any of whose types (entity_id, types) is whitelisted."""
    fine = types.select("entity_id", F.explode("types").alias("type_id")).join(whitelist.select("type_id").distinct(), "type_id", "left_semi")
    return predictions.join(fine.select("entity_id").distinct(), "entity_id", "left_semi")


def outside_span(mentions: DataFrame) -> DataFrame:
    """Mentions that end before the evaluation span (begin, stop) or start at or behind its end."""
    return mentions.where((F.col("end") < F.col("begin")) | (F.col("start") >= F.col("stop")))


def annotation_class() -> Column:
    """Display class of a case from booleans tp, fp, fn, unknown, optional, evaluated."""
    return (
        F.when(~F.col("evaluated"), "unevaluated").when(F.col("optional"), "optional").when(F.col("unknown") & ~F.col("fp"), "unknown")
        .when(F.col("tp"), "tp").when(F.col("fp") & F.col("fn"), "fp fn").when(F.col("fp"), "fp").when(F.col("fn"), "fn").otherwise("unevaluated")
    )


def gold_as_predictions(labels: DataFrame) -> DataFrame:
    """The self-test linker: gold labels predicted as they are."""
    return labels.select("article_id", "start", "end", "entity_id", F.array("entity_id").alias("candidates"))


def drill_down(category: str) -> list[str]:
    """Error tags of a column name base|category|sub."""
    _, group, sub = category.split("|")
    if group == "error_categories":
        return [f"{sub.upper()}_WRONG"]
    return [f"{group.upper()}_{sub.upper()}_WRONG" if group.startswith("wrong") else f"{group.upper()}_{sub.upper()}"]
