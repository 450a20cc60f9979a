"""Type graphs: closures, cuts, corrections, sub-graphs and the declarative query catalogue.

Edges are (s, p, o). The closure of all classes doubles the depth it covers in each round; the classes below or above one class
are grown level by level: each level joins the frontier with the edges and drops what was reached before (an
anti-join). So cycles end and depths are smallest depths. Each round is written out, which keeps plans short and survives
lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

INSTANCE_OF, SUBCLASS_OF = "P31", "P279"


def _grow(front: DataFrame, edges: DataFrame, most: int = 10_000) -> DataFrame:
    """(entity_id, cls, depth) -> all classes reached over (sub, sup), each with its smallest depth."""
    front = cut(front)
    seen, step = front, 0
    while step < most:
        step += 1
        new = front.join(edges, F.col("cls") == F.col("sub")).select("entity_id", F.col("sup").alias("cls"), (F.col("depth") + 1).alias("depth")).distinct()
        new = new.join(seen.select(F.col("entity_id").alias("_e"), F.col("cls").alias("_c")), (F.col("entity_id") == F.col("_e")) & (F.col("cls") == F.col("_c")), "left_anti")
        new = cut(new)
        if new.isEmpty():
            return seen
        seen, front = seen.unionByName(new), new
    raise RuntimeError("the closure did not end")


def _edges(triples: DataFrame, predicate: str) -> DataFrame:
    return triples.where(F.col("p") == predicate).select(F.col("s").alias("sub"), F.col("o").alias("sup")).distinct()


def class_closure(edges: DataFrame, most: int = 40) -> DataFrame:
    """sub, sup, depth: all classes above each class, by smallest depth (1 for direct ones).

    Known over classes only, whatever number of entities they have. Each round joins the pairs with themselves, so that the depth
    covered doubles; a round whose greatest depth is below that has found all.
    """
    pairs = cut(edges.where("sub != sup").select("sub", "sup", F.lit(1).alias("depth")))
    for k in range(1, most):
        on = pairs.select(F.col("sub").alias("_s"), F.col("sup").alias("_t"), F.col("depth").alias("_d"))
        longer = pairs.join(on, F.col("sup") == F.col("_s")).select("sub", F.col("_t").alias("sup"), (F.col("depth") + F.col("_d")).alias("depth")).where("sub != sup")
        pairs = cut(pairs.unionByName(longer).groupBy("sub", "sup").agg(F.min("depth").alias("depth")))
        if (pairs.agg(F.max("depth")).first()[0] or 0) < 1 << k:
            return pairs
    raise RuntimeError("the closure did not end")


def all_types(triples: DataFrame, sitelinks: DataFrame | None = None, least: int = 2) -> DataFrame:
    """entity_id, cls, depth: direct classes (instance or subclass) at depth 0, then superclasses by smallest depth.

    Only entities that are an instance of something, and have ``least`` sitelinks (entity_id, n) if given. Classes are closed
    first; entities meet their closure in one join.
    """
    direct = triples.where(F.col("p").isin(INSTANCE_OF, SUBCLASS_OF)).groupBy(F.col("s").alias("entity_id"), F.col("o").alias("cls")).agg(F.max(F.col("p") == INSTANCE_OF).alias("_is"))
    start = direct.withColumn("_any", F.max("_is").over(Window.partitionBy("entity_id"))).where("_any").select("entity_id", "cls")
    if sitelinks is not None:
        popular = sitelinks.where(F.col("n") >= least).select(F.col("entity_id").alias("_e"))
        start = start.join(popular, F.col("entity_id") == F.col("_e"), "left_semi")
    above = class_closure(_edges(triples, SUBCLASS_OF))
    reached = start.join(above, F.col("cls") == F.col("sub")).select("entity_id", F.col("sup").alias("cls"), "depth")
    return start.withColumn("depth", F.lit(0)).unionByName(reached).groupBy("entity_id", "cls").agg(F.min("depth").alias("depth"))


def types_line(types: DataFrame) -> DataFrame:
    """entity_id, types: depth:class elements ordered by (depth, class), joined by ;."""
    listed = F.array_sort(F.collect_list(F.struct("depth", "cls")))
    return types.groupBy("entity_id").agg(F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["depth"].cast("string"), x["cls"])), ";").alias("types"))


def coreference_types(types: DataFrame, coarse: DataFrame) -> DataFrame:
    """entity_id, types: classes up to the cut, joined by ; in (depth, class) order.

    The cut is the least of 3, the first level that holds a coarse class, and the first level that is at most one
    below the highest.
    """
    marked = types.join(coarse.select(F.col("type_id").alias("_c")).distinct(), F.col("cls") == F.col("_c"), "left")
    group = Window.partitionBy("entity_id")
    highest = F.max("depth").over(group)
    marked = marked.withColumn("_high", highest).withColumn("_coarse", F.min(F.when(F.col("_c").isNotNull(), F.col("depth"))).over(group))
    near = F.min(F.when(F.col("depth") >= F.col("_high") - 1, F.col("depth"))).over(group)
    cut = F.least(F.lit(3), F.coalesce("_coarse", F.lit(3)), F.coalesce(near, F.lit(3)))
    kept = marked.withColumn("_cut", cut).where("depth <= _cut")
    listed = F.array_sort(F.collect_list(F.struct("depth", "cls")))
    return kept.groupBy("entity_id").agg(F.array_join(F.transform(listed, lambda x: x["cls"]), ";").alias("types"))


def whitelist_types(triples: DataFrame, whitelist: DataFrame) -> DataFrame:
    """entity_id, type_id: whitelisted classes of which an entity is an instance, directly or over superclasses."""
    listed = whitelist.select("type_id").distinct()
    above = class_closure(_edges(triples, SUBCLASS_OF)).join(listed, F.col("sup") == F.col("type_id"), "left_semi").select("sub", F.col("sup").alias("type_id"))
    kinds = above.unionByName(listed.select(F.col("type_id").alias("sub"), "type_id"))
    rows = triples.where(F.col("p") == INSTANCE_OF).select(F.col("s").alias("entity_id"), F.col("o").alias("cls"))
    return rows.join(kinds, F.col("cls") == F.col("sub")).select("entity_id", "type_id").distinct()


def instances_of(triples: DataFrame, root: str) -> DataFrame:
    """entity_id of all instances of a class or of its subclasses: the subclasses are grown down from the root."""
    down = _edges(triples, SUBCLASS_OF).select(F.col("sup").alias("sub"), F.col("sub").alias("sup"))
    start = triples.sparkSession.range(1).select(F.lit(root).alias("entity_id"), F.lit(root).alias("cls"), F.lit(0).alias("depth"))
    classes = _grow(start, down).select(F.col("cls").alias("_c"))
    return triples.where(F.col("p") == INSTANCE_OF).join(classes, F.col("o") == F.col("_c"), "left_semi").select(F.col("s").alias("entity_id")).distinct()


def corrected(triples: DataFrame, corrections: DataFrame) -> DataFrame:
    """Triples without the removed ones, and with the added ones (these are not subject to removal)."""
    gone = corrections.where("action = 'REMOVE'").select(*[F.col(c).alias(f"_{c}") for c in "spo"])
    same = (F.col("s") == F.col("_s")) & (F.col("p") == F.col("_p")) & (F.col("o") == F.col("_o"))
    return triples.select("s", "p", "o").join(gone, same, "left_anti").unionByName(corrections.where("action = 'ADD'").select("s", "p", "o")).distinct()


def subgraph(triples: DataFrame, entity: str, labels: DataFrame, scores: DataFrame) -> DataFrame:
    """s, p, o, s_label, o_label, s_score, o_score: the entity's instance edges and all subclass edges above, by score.

    labels: (id, label), scores: (id, score), one row an id.
    """
    start = triples.where((F.col("s") == entity) & (F.col("p") == INSTANCE_OF)).select(F.lit(entity).alias("entity_id"), F.col("o").alias("cls"), F.lit(0).alias("depth")).distinct()
    above = _grow(start, _edges(triples, SUBCLASS_OF)).select(F.col("cls").alias("_c"))
    first = triples.where((F.col("s") == entity) & (F.col("p") == INSTANCE_OF))
    rest = triples.where(F.col("p") == SUBCLASS_OF).join(above, F.col("s") == F.col("_c"), "left_semi")
    out = first.unionByName(rest).select("s", "p", "o").distinct()
    for end in "so":
        l, c = labels.select(F.col("id").alias("_i"), F.col("label").alias(f"{end}_label")), scores.select(F.col("id").alias("_j"), F.col("score").alias(f"{end}_score"))
        out = out.join(l, F.col(end) == F.col("_i"), "left").join(c, F.col(end) == F.col("_j"), "left").drop("_i", "_j")
    return out.select("s", "p", "o", "s_label", "o_label", "s_score", "o_score").orderBy(F.desc_nulls_last("s_score"), "s", "p", "o")


def completions(labels: DataFrame, scores: DataFrame, prefix: str, k: int = 7) -> DataFrame:
    """The k labels of highest score that begin with a prefix."""
    found = labels.where(F.startswith("label", F.lit(prefix))).join(scores.withColumnRenamed("id", "_i"), F.col("id") == F.col("_i"))
    return found.select("id", "label", "score").orderBy(F.desc("score"), "id").limit(k)


class KnowledgeQueries:
    """The declarative queries, over triples (s, p, o) and labels (id, label, lang).

    Predicates are parameters with their usual values.
    """

    # Properties and classes.
    GENDER, DEMONYM, SITELINKS, ALIAS, PAGE = "P21", "P1549", "sitelinks", "alias", "page"
    LANGUAGE, QUANTITY, DATE, HUMAN, NAME = "Q34770", "Q12916", "Q186408", "Q5", "Q95074"

    def __init__(self, triples: DataFrame, labels: DataFrame):
        self.t, self.labels = triples, labels.where("lang = 'en'").select("id", "label").distinct()

    def predicate(self, *p: str) -> DataFrame:
        return self.t.where(F.col("p").isin(*p)).select("s", "o")

    def _labelled(self, rows: DataFrame, key: str) -> DataFrame:
        return rows.join(self.labels, F.col(key) == F.col("id")).drop("id")

    def labels_of(self) -> DataFrame:
        return self.labels

    def demonyms(self) -> DataFrame:
        return self.predicate(self.DEMONYM).select(F.col("s").alias("entity_id"), F.regexp_extract("o", "^(.*)@en$", 1).alias("demonym")).where("demonym != ''")

    def languages(self) -> DataFrame:
        return self._labelled(instances_of(self.t, self.LANGUAGE), "entity_id").distinct()

    def quantities(self) -> DataFrame:
        return instances_of(self.t, self.QUANTITY)

    def dates(self) -> DataFrame:
        return instances_of(self.t, self.DATE)

    def genders(self) -> DataFrame:
        return self._labelled(self.predicate(self.GENDER).select(F.col("s").alias("entity_id"), "o"), "o").select("entity_id", F.col("label").alias("gender"))

    def names(self) -> DataFrame:
        people = self.predicate(INSTANCE_OF).where(F.col("o") == self.HUMAN).select(F.col("s").alias("entity_id"))
        return self._labelled(people.unionByName(instances_of(self.t, self.NAME)).distinct(), "entity_id").distinct()

    def sitelinks(self) -> DataFrame:
        n = self.predicate(self.SITELINKS).select(F.col("s").alias("entity_id"), F.col("o").cast("long").alias("n"))
        return n.where("n > 0").orderBy(F.desc("n"), "entity_id")

    def aliases(self) -> DataFrame:
        rows = self.predicate(self.ALIAS).groupBy(F.col("s").alias("entity_id")).agg(F.array_join(F.array_sort(F.collect_list("o")), ";").alias("aliases"))
        return rows.orderBy("entity_id")

    def pages(self, site: str) -> DataFrame:
        return self.predicate(self.PAGE).where(F.startswith("o", F.lit(site))).select(F.col("s").alias("entity_id"), F.col("o").alias("url"))

    def type_counts(self) -> DataFrame:
        return self.predicate(INSTANCE_OF).groupBy(F.col("s").alias("entity_id")).agg(F.count("*").alias("n_types"))
