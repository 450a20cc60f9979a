"""Operators against hand-made cases, plain Python versions and properties."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.functions import text as tx
from loomspan.operators import annotated, evaluation, exports, graph, linking, mappings, ml, resolve, spans, splits
from loomspan.plans import registry, report
from loomspan.streaming import annotate


def plain_closure(edges, starts):
    out = {}
    for q, direct in starts.items():
        depth, front = {}, set(direct)
        d = 0
        while front:
            depth.update(dict.fromkeys(front, d))
            front = {b for a, b in edges if a in front} - set(depth)
            d += 1
        out |= {(q, c): d for c, d in depth.items()}
    return out


def test_closure_on_random_cyclic_graphs(spark):
    rng = random.Random(2)
    for _ in range(2):
        up = [(f"C{rng.randrange(12)}", f"C{rng.randrange(12)}") for _ in range(18)]
        inst = [(f"E{rng.randrange(6)}", f"C{rng.randrange(12)}") for _ in range(9)]
        sub = [("E1", "C3")]
        t = spark.createDataFrame([(a, "P279", b) for a, b in up + sub] + [(a, "P31", b) for a, b in inst], ["s", "p", "o"])
        starts = {}
        for a, b in inst:
            starts.setdefault(a, set()).add(b)
        if "E1" in starts:
            starts["E1"].add("C3")
        got = {(r.entity_id, r.cls): r.depth for r in graph.all_types(t).collect()}
        assert got == plain_closure(up, starts)


def plain_cut(types, coarse):
    high = max(d for d, _ in types)
    cut = min([3, *[d for d, c in types if c in coarse], *[d for d, _ in types if d >= high - 1]])
    return ";".join(c for d, c in sorted(types) if d <= cut)


def test_coreference_cut(spark):
    rng = random.Random(3)
    rows = {f"E{i}": sorted({(rng.randrange(6), f"C{rng.randrange(30)}") for _ in range(rng.randrange(1, 8))} | {(0, "C29")}) for i in range(60)}
    df = spark.createDataFrame([(e, c, d) for e, ts in rows.items() for d, c in ts], "entity_id string, cls string, depth int")
    got = {r.entity_id: r.types for r in graph.coreference_types(df, spark.createDataFrame([("C1",), ("C2",)], ["type_id"])).collect()}
    assert got == {e: plain_cut(ts, {"C1", "C2"}) for e, ts in rows.items()}


def test_sitelink_filter_and_catalogue(spark):
    t = spark.createDataFrame([("A", "P31", "Q5"), ("B", "P31", "L"), ("L", "P279", "Q34770"), ("A", "P21", "M"), ("A", "P1549", "Roman@en"), ("A", "P1549", "romain@fr"), ("A", "sitelinks", "7"), ("B", "sitelinks", "0"), ("A", "alias", "y"), ("A", "alias", "x"), ("A", "page", "https://en/x"), ("A", "page", "https://de/x")], ["s", "p", "o"])
    labels = spark.createDataFrame([("A", "Ann", "en"), ("B", "Basque", "en"), ("M", "male", "en"), ("A", "Anne", "fr")], ["id", "label", "lang"])
    k = graph.KnowledgeQueries(t, labels)
    one = lambda df: sorted(map(tuple, df.collect()))
    assert one(k.demonyms()) == [("A", "Roman")]
    assert one(k.languages()) == [("B", "Basque")] and one(k.quantities()) == [] and one(k.dates()) == []
    assert one(k.genders()) == [("A", "male")] and one(k.names()) == [("A", "Ann")]
    assert one(k.sitelinks()) == [("A", 7)] and one(k.aliases()) == [("A", "x;y")] and one(k.pages("https://en")) == [("A", "https://en/x")]
    assert one(k.labels_of()) == [("A", "Ann"), ("B", "Basque"), ("M", "male")]
    few = graph.all_types(t, spark.createDataFrame([("A", 7), ("B", 1)], "entity_id string, n int"))
    assert {r.entity_id for r in few.collect()} == {"A"}


intervals = st.lists(st.tuples(st.integers(0, 40), st.integers(1, 10)).map(lambda t: (t[0], t[0] + t[1])), min_size=1, max_size=12)


@pytest.fixture(scope="module")
def folds(spark):
    def run(rows):
        df = spark.createDataFrame([(i, [(*s, j % 2 == 0) for j, s in enumerate(r)]) for i, r in enumerate(rows)], "i int, s array<struct<start:int,end:int,has_gold:boolean>>")
        got = df.select("i", spans.greedy(F.col("s")).alias("g"), spans.keep_longer(F.col("s")).alias("k")).orderBy("i").collect()
        return [([tuple(x)[:2] for x in r.g], [tuple(x) for x in r.k]) for r in got]

    return run


@settings(max_examples=3, deadline=None)
@given(st.lists(intervals, min_size=20, max_size=40))
def test_greedy_and_display_order(folds, rows):
    for row, (kept, shown) in zip(rows, folds(rows), strict=True):
        want = []
        for s, e in row:
            if all(e <= a or b <= s for a, b in want):
                want.append((s, e))
        assert kept == want
        assert all(a[1] <= b[0] for a, b in zip(shown, shown[1:], strict=False))


def test_display_prefers_gold(spark):
    df = spark.createDataFrame([([(0, 4, True), (2, 9, False), (10, 12, False), (11, 15, True)],)], "s array<struct<start:int,end:int,has_gold:boolean>>")
    assert [tuple(x) for x in df.select(spans.keep_longer(F.col("s")).alias("k")).first().k] == [(0, 4, True), (11, 15, True)]


def test_segments(spark):
    kind = "article_id int, id string, start int, end int"
    outer = spark.createDataFrame([(1, "a", 0, 10), (1, "b", 12, 20)], kind)
    inner = spark.createDataFrame([(1, "x", 3, 5), (1, "y", 8, 14)], kind)
    got = sorted((r.start, r.end, r.outer, r.inner) for r in spans.segments(outer, inner).collect())
    assert got == [(0, 3, "a", None), (3, 5, "a", "x"), (5, 8, "a", None), (8, 10, "a", "y"), (12, 14, "b", "y"), (14, 20, "b", None)]


def test_touching_meets_each_overlapping_pair_once(spark):
    import random

    rnd = random.Random(3)
    some = lambda n: [(rnd.randrange(2), k, a, a + rnd.choice((0, 1, 5, 90, 300))) for k in range(n) for a in [rnd.randrange(400)]]
    left, right = some(60), [*some(60), (None, 60, 1, 5), (1, 61, None, 5)]
    frame = lambda rows: spark.createDataFrame(rows, "article_id long, id int, start int, end int")
    got = sorted((r.id, r.other.id) for r in spans.touching(frame(left), frame(right)).collect())
    assert got == sorted((a[1], b[1]) for a in left for b in right if a[0] == b[0] and b[2] is not None and a[2] < b[3] and b[2] < a[3])


def test_splice_round_trip(spark):
    df = spark.createDataFrame([("a😀b Paris and Rome", [(4, 9, "Q90", "Paris"), (14, 18, "Q220", "Roma")])], "t string, s array<struct<start:int,end:int,entity_id:string,name:string>>")
    out = df.select(spans.splice(F.col("t"), F.col("s"), spans.gold_annotation).alias("x"), spans.entity_list(F.col("s")).alias("l")).first()
    assert out.x == "a😀b [Q90:Paris|Paris] and [Q220:Roma|Rome]" and out.l == "Q90:Paris\nQ220:Roma"
    assert annotated.parse(out.x)[0] == "a😀b Paris and Rome"
    links = spark.createDataFrame([("see Paris, Rome", [(4, 9, "Paris"), (11, 15, "Roma")])], "t string, s array<struct<start:int,end:int,target:string>>")
    assert links.select(spans.splice(F.col("t"), F.col("s"), spans.link_annotation).alias("x")).first().x == "see [[Paris]], [[Roma|Rome]]"


def test_nested_annotations(spark):
    body = "The [OPTIONAL:Q1:A [x|[Q2:B|inner] outer [to] end] and [COREF:Q3:C|it [Q4:D|deep]]."
    text, labels = annotated.parse("The [OPTIONAL:Q1:A|[Q2:B|inner] outer [to] end] and [COREF:Q3:C|it [Q4:D|deep]].")
    assert text == "The inner outer [to] end and it deep."
    assert [(x["entity_id"], text[x["start"] : x["end"]], x["parent"], x["children"]) for x in labels] == [("Q1", "inner outer [to] end", None, [1]), ("Q2", "inner", 0, []), ("Q3", "it deep", None, [3]), ("Q4", "deep", 2, [])]
    assert labels[0]["optional"] and labels[2]["coref"]
    left = annotated.delete(labels, {2})
    assert [(x["id"], x["parent"]) for x in left] == [(0, None), (1, 0), (3, None)]
    df = spark.createDataFrame([(1, body.replace(" [x", "")), (2, None)], "article_id long, body string")
    assert {r.entity_id for r in annotated.labels(df, coreference=False).collect()} == {"Q1", "Q2", "Q4"}


def test_evaluation_of_gold_is_perfect(spark):
    rng = random.Random(4)
    rows = [(a, 10 * i, 10 * i + 5, rng.choice(["Q1", "Q2", "Q3"]), rng.choice(["T1", "T2|T3", ""]), rng.choice(["Word", "word", "it"])) for a in range(10) for i in range(6)]
    labels = spark.createDataFrame(rows, "article_id long, start int, end int, entity_id string, type string, text string")
    typed = evaluation.eval_types(evaluation.cases(labels, labels))
    typed = typed.withColumn("mention_type", evaluation.mention_type(F.col("gold.text"), F.col("gold.entity_id"), F.lit(False)))
    for m in evaluation.mention_type_metrics(typed).collect():
        assert (m.precision, m.recall, m.f1, m.fp, m.fn) == (1, 1, 1, 0, 0)
    by = {(m["mode"], m.category): m for m in evaluation.mention_type_metrics(typed).collect()}
    assert by["REQUIRED", "all"].tp == by["REQUIRED", "entity"].tp + by["REQUIRED", "coref"].tp == 60
    assert all(m.f1 == 1 for m in evaluation.ner_metrics(typed).collect())
    zero = evaluation.with_ratios(spark.createDataFrame([(0, 0, 0)], "tp int, fp int, fn int")).first()
    assert (zero.precision, zero.recall, zero.f1) == (0, 0, 0)


def test_unknown_gold_by_mode(spark):
    kind = "article_id int, start int, end int, entity_id string"
    labels = spark.createDataFrame([(1, 0, 3, "<NIL>"), (1, 5, 8, "Q1"), (1, 9, 12, "<NIL>")], kind)
    found = spark.createDataFrame([(1, 0, 3, "Q9"), (1, 20, 22, "<NO_MAPPING>")], kind)
    got = {r.start: (r.required, r.ignored) for r in evaluation.eval_types(evaluation.cases(labels, found)).collect()}
    assert got == {0: (["FN", "FP"], ["FP"]), 5: (["FN"], ["FN"]), 9: (["FN"], []), 20: (["FP"], [])}


def test_small_evaluation_operators(spark):
    cases = spark.createDataFrame([({"IGNORED": ["DISAMBIGUATION_OTHER_WRONG", "RARE"]},), ({"IGNORED": ["DISAMBIGUATION_WRONG_OTHER"]},), (None,)], "error_labels map<string,array<string>>")
    assert {r.tag: r.n for r in evaluation.tag_counts(cases, "IGNORED").collect()} == {"DISAMBIGUATION_WRONG_OTHER": 2, "RARE": 1}
    m = spark.createDataFrame([(0, 5, 5, 9), (1, 6, 5, 9), (9, 12, 5, 9)], "start int, end int, begin int, stop int")
    assert sorted(r.start for r in evaluation.outside_span(m).collect()) == [9]
    c = spark.createDataFrame([(True, False, False, False, False, True), (False, True, True, False, False, True), (False, False, False, True, False, True), (False, False, True, False, True, True), (True, False, False, False, False, False)], "tp boolean, fp boolean, fn boolean, unknown boolean, optional boolean, evaluated boolean")
    assert [r.c for r in c.select(evaluation.annotation_class().alias("c")).collect()] == ["tp", "fp fn", "unknown", "optional", "unevaluated"]
    fp = spark.createDataFrame([("It",), ("Rome",)], ["text"])
    assert evaluation.false_coreference_detections(fp).count() == 1


LINKS = "id long, ordinal long, title string, text string, hyperlinks array<struct<start:int,end:int,target:string>>, title_synonyms array<struct<start:int,end:int>>"


def resources(spark):
    return {
        "titles": spark.createDataFrame([("Ann Lee", "Q1"), ("Paris", "Q2"), ("Thing", "Q3")], "title string, entity_id string"),
        "redirects": spark.createDataFrame([("City of Light", "Paris")], "title string, target string"),
        "names": spark.createDataFrame([("Q1", "Ann Lee"), ("Q2", "Paris"), ("Q3", "Thing")], "entity_id string, name string"),
        "types": spark.createDataFrame([("Q1", ["Q5"]), ("Q2", ["Q486972"]), ("Q3", ["OTHER"])], "entity_id string, types array<string>"),
        "aliases": spark.createDataFrame([("Q2", ["Lutetia", "lutetia"]), ("Q1", ["Annie"])], "entity_id string, aliases array<string>"),
    }


def test_linkers(spark):
    text = "Ann Lee moved to Paris's center. Ann liked Lutetia, lutetia and Parisians. It was a Thing."
    arts = spark.createDataFrame([(1, 0, "Ann Lee", text, [(17, 24, "City of Light"), (text.index("Thing"), text.index("Thing") + 5, "Thing"), (0, 3, "Missing")], [(0, 7)])], LINKS)
    r = resources(spark)
    only = sorted((x.start, x.end, x.entity_id) for x in linking.by_hyperlinks(arts, r["titles"], r["redirects"]).collect())
    assert only == [(17, 24, "Q2"), (84, 89, "Q3")]
    full = sorted((text[x.start : x.end], x.entity_id) for x in registry.Pipeline(linker="hyperlink-reference", resources=r).link(arts).collect())
    assert full == [("Ann", "Q1"), ("Ann Lee", "Q1"), ("Lutetia", "Q2"), ("Paris", "Q2")]
    r |= {"candidates": spark.createDataFrame([("Paris", "Q2", 40, 0), ("Paris", "Q9", 60, 1), ("Ann", "Q1", 3, 0)], "surface string, entity_id string, score int, source_rank int")}
    popular = registry.Pipeline(linker="popular-entities", hyperlink_linker="hyperlinks-only", coreference="pronouns", resources=r).link(arts)
    out = sorted((x.start, x.end, x.entity_id) for x in popular.collect())
    assert all(a[1] <= b[0] for a, b in zip(out, out[1:], strict=False)) and (17, 24, "Q2") in out
    with pytest.raises(ValueError):
        registry.Pipeline(linker="nope")
    attached = registry.attach(arts, popular).first()
    assert [m.start for m in attached.entity_mentions] == [s for s, _, _ in out]


def test_scan_rules():
    scan = linking.ArticleScan("He met Bob's dog. Bobby and Bob ran to Bob", "X", None, [], [{"start": 7, "end": 12, "target": "Bob", "entity_id": "Q1"}], [{"entity_id": "Q1", "surfaces": ["Rob"], "variants": None, "given": None}])
    assert sorted(scan.found) == [(7, 10, "Q1", "HYPERLINK")]  # "Bob's" is what was linked; the bare name was never seen
    scan = linking.ArticleScan("The Roman Empire fell. Romans", "X", None, [], [{"start": 4, "end": 9, "target": "Roman Empire", "entity_id": "Q1"}], [])
    assert (4, 16, "Q1", "HYPERLINK") in scan.found


def plain_links(text, title, title_entity, bold, links, aliases, variants, given):
    """The rules of the hyperlink-reference linker, written from the survey: sets of positions, one rule after the other."""
    names, synonyms, covered, out = {}, {}, set(), []

    def learn(e):
        for a in aliases.get(e, ()):
            if a not in synonyms:
                synonyms[a] = e
        for v in variants.get(e, ()):
            synonyms[v] = e

    def grown(end):
        while end + 1 < len(text) and text[end].isalpha():
            end += 1
        return end

    if title_entity:
        names[title] = title_entity
        learn(title_entity)
        bare = title.split(" (")[0] if title.endswith(")") else title
        if bare != title and bare not in synonyms:
            synonyms[bare] = title_entity
    for start, end, target, e in [(s, t, title, title_entity) for s, t in bold if title_entity] + links:
        if covered & set(range(start, end)):
            continue
        names[text[start:end]] = e
        learn(e)
        stop = end
        for tail in ("'s", "'"):
            if text[start:end].endswith(tail) and not target.endswith(tail):
                stop -= len(tail)
        if text[start : start + len(target)] == target:
            stop = max(stop, start + len(target))
        stop = grown(stop)
        covered |= set(range(start, stop))
        out.append((start, stop, e))
    for e in [title_entity] + [x[2] for x in out]:
        if e in given and given[e] not in synonyms:
            synonyms[given[e]] = e
    for name, e in sorted(names.items(), key=lambda x: -len(x[0])) + sorted(synonyms.items(), key=lambda x: -len(x[0])):
        at = 0
        while name and (start := text.find(name, at)) >= 0:
            if start and text[start - 1].isalpha():
                at = start + 1
                continue
            at = stop = grown(start + len(name))
            first = start and text[:start].rstrip()[-1:] in {".", ""} and text[start - 1].isspace()
            if stop - start - len(name) > min(3, len(name)) or covered & set(range(start, stop)) or first and " " not in name and name.lower() in linking.PRONOUNS:
                continue
            covered |= set(range(start, stop))
            out.append((start, stop, e))
    return sorted(out)


def test_scan_equals_a_plain_version():
    """Random articles: links, bold titles, aliases, variants and given names; equal mentions."""
    rng = random.Random(11)
    parts = ["Ann", "Ann Lee", "Lee", "Bo", "Bob's", "It", "This", "Rome", "Romans", "the", "x", "Ann L. Lee", "Lee (Rome)"]
    for trial in range(400):
        words = [rng.choice(parts) for _ in range(rng.randrange(1, 25))]
        text, spans_ = "", []
        for w in words:
            text += rng.choice([" ", ". ", "", ", "]) if text else ""
            spans_.append((len(text), len(text) + len(w), w))
            text += w
        some = lambda k: [x for x in spans_ if rng.random() < k]
        ids = [f"Q{i}" for i in range(4)]
        links = [(s, t, rng.choice([w, w + "s", "Ann Lee", "Rome"]), rng.choice(ids)) for s, t, w in some(0.2)]
        bold = [(s, t) for s, t, _ in some(0.1)]
        own = lambda k: {e: rng.sample(["Lee", "Ann", "This", "Bo", "Rome", "It", "Ann L. Lee"], rng.randrange(k)) for e in ids}
        aliases, variants, given = own(4), own(2), {e: rng.choice(["Ann", "Bo"]) for e in ids if rng.random() < 0.4}
        title, entity = rng.choice(["Ann Lee", "Lee (Rome)", "This"]), rng.choice([None, "Q0"])
        facts = [{"entity_id": e, "surfaces": aliases[e], "variants": variants[e], "given": given.get(e)} for e in ids]
        scan = linking.ArticleScan(text, title, entity, [{"start": s, "end": t} for s, t in bold], [dict(zip(("start", "end", "target", "entity_id"), x, strict=True)) for x in links], facts)
        want = plain_links(text, title, entity, bold, links, aliases, variants, given)
        assert sorted(x[:3] for x in scan.found) == want, (text, title, entity, links, want)


def test_annotation_variants(spark):
    """With coreference, alternatives for the case without go; unknown entities are <NIL>, values are their own type."""
    body = "[COREF:Q1:A|the [NO_COREF_ALT:Q2:B|famous [Unknown1:C|x] singer]] on [DATETIME:May|May 1], [Q3:D|it]"
    df = spark.createDataFrame([(1, body)], "article_id long, body string")
    got = lambda c: sorted((r.id, r.entity_id, r.type, r.parent, r.children) for r in annotated.labels(df, coreference=c).collect())
    assert got(True) == [(0, "Q1", "OTHER", None, [2]), (2, "<NIL>", "OTHER", 0, []), (3, "DATETIME", "DATETIME", None, []), (4, "Q3", "OTHER", None, [])]
    assert got(False) == [(1, "Q2", "OTHER", None, [2]), (2, "<NIL>", "OTHER", 1, []), (3, "DATETIME", "DATETIME", None, []), (4, "Q3", "OTHER", None, [])]


def test_resolution(spark):
    r = resources(spark)
    got = {x.t: x.entity_id for x in resolve.link_to_id(spark.createDataFrame([("Paris",), ("City of Light",), ("?",)], ["t"]), "t", r["titles"], r["redirects"]).collect()}
    assert got == {"Paris": "Q2", "City of Light": "Q2", "?": None}
    labels = spark.createDataFrame([("Q1", "x", "t"), ("<NIL>", "y", "keep"), ("Q7", "z", "DATETIME"), ("Q8", "w", "t")], "entity_id string, name string, type string")
    assert {x.entity_id: x.type for x in resolve.annotate_labels(labels, r["names"], r["types"]).collect()} == {"Q1": "Q5", "<NIL>": "keep", "Q7": "DATETIME", "Q8": "OTHER"}
    arts = spark.createDataFrame([(1, 0, "same start A"), (2, 1, "same start B"), (3, 2, "other")], "id long, ordinal long, text string")
    found = resolve.prefix_lookup(spark.createDataFrame([("same start A",), ("none",)], ["text"]), arts, 10).collect()
    assert sorted(map(str, [tuple(x) for x in found])) == sorted(map(str, [("same start A", 2, False, 2), ("none", None, None, None)]))


def test_mappings(spark):
    f = mappings.link_frequencies(spark.createDataFrame([("a", "Q1", 0), ("a", "Q2", 1), ("a", "Q2", 2), ("a", "Q1", 3), ("b", None, 4), ("b", None, 5)], "link_text string, entity_id string, ordinal int"))
    assert sorted(map(str, [tuple(x) for x in f.collect()])) == sorted(map(str, [("a", "Q1", 2, 0), ("a", "Q2", 2, 1), ("b", None, 0, 4)]))
    assert [tuple(x) for x in mappings.most_popular_candidates(f).collect()] == [("a", "Q1,Q2")]
    kb = mappings.custom_knowledge_base(spark.createDataFrame([("e", "name", "First", 0), ("e", "name", "Last", 1), ("e", "type", "t", 2), ("e", "type", "u", 3), ("t", "name", "Kind", 4)], "s string, p string, o string, ordinal int"), "name", "type")
    assert {r.entity_id: r.name for r in kb["names"].collect()} == {"e": "Last", "t": "Kind"}
    assert kb["types"].first().types == ["t", "u"] and {r.type_id: r.name for r in kb["type_names"].collect()} == {"t": "Kind", "u": "OTHER"}
    arts = spark.createDataFrame([("Paris", "a\nb", 0), ("Paris", "last", 1), ("?", "x", 2)], "title string, abstract string, ordinal int")
    r = resources(spark)
    assert [tuple(x) for x in mappings.abstracts(arts, r["titles"], r["redirects"]).collect()] == [("Q2", "Paris", "last")]
    assert tuple(mappings.abstract_counters(arts, r["titles"], r["redirects"]).first()) == (1, 1)
    types = spark.createDataFrame([(["Q95074", "Q1"],), (["Q729", "Q5"],), (["Q729"],)], "t array<string>")
    rules = [("Q95074", "REPLACE_WITH", "Q5"), ("Q729", "MINUS", "Q5")]
    assert [r.x for r in types.select(mappings.adjusted_types(F.col("t"), rules).alias("x")).collect()] == [["Q5", "Q1"], ["Q5"], ["Q729"]]
    inv = mappings.inverted(spark.createDataFrame([(0, "k", "a;b"), (1, "l", "b")], "ordinal int, key string, value string"), ";")
    assert {x.key: x.value for x in mappings.multi_value(inv).collect()} == {"a": "k", "b": "k,l"}


def test_candidate_totals_add_up_candidates(spark):
    linked = spark.createDataFrame([("a", "Q1", 0), ("a", "Q2", 1), ("a", "Q2", 2), ("a", None, 3), ("b", None, 4), ("c", "Q1", 5), (None, "Q3", 6)], "link_text string, entity_id string, ordinal int")
    f = mappings.resolved_frequencies(linked)
    assert sorted(map(str, f.collect())) == sorted(map(str, mappings.link_frequencies(linked).where("n > 0").collect()))
    mentions = spark.createDataFrame([(1, "a"), (1, "a"), (1, "c"), (2, "b"), (3, None), (4, "c"), (None, "a")], "article_id long, text string")
    got = resolve.candidate_totals(mentions, mappings.priors(f))
    want = resolve.candidates(mentions, mappings.priors(f)).groupBy("article_id").agg(F.count("*").alias("n_candidates"), F.max("count").alias("best"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {x.article_id: (x.n_candidates, x.best) for x in got.collect()} == {1: (5, 2), 4: (1, 1), None: (2, 2)}


def test_text_functions(spark):
    df = spark.createDataFrame([("{hint} rest", "sys.v1.bench", "É!", "x y/z")], "d string, e string, m string, t string")
    row = df.select(tx.strip_description(F.col("d")), tx.experiment_name(F.col("e")), tx.benchmark_name(F.col("e")), tx.first_letter_is_upper(F.col("m")), tx.ascii_mask(F.col("m")), tx.quote_title(F.col("t")), tx.percent(F.lit(0.12345)), tx.is_all_lower(F.lit("123"))).first()
    assert tuple(row) == (" rest", "sys.v1", "bench", True, "_!", "x_y/z", "12.35%" if f"{12.345:.2f}" == "12.35" else "12.34%", False) or row[6] in ("12.34%", "12.35%")


def test_exports(spark):
    arts = spark.createDataFrame([(0, 10, "T", "One two. Three\nFour."), (1, 11, "U", "Five")], "ordinal long, id long, title string, text string")
    sents = exports.sentences(arts)
    docs = sorted(map(tuple, exports.docs_file(sents).collect()))
    assert [d[0] for d in docs] == [0, 1, 2, 3] and [d[1].strip() for d in docs] == ["One two.", "Three", "Four.", "Five"]
    mentions = spark.createDataFrame([(10, 4, 7, "Q1"), (11, 0, 4, "<NIL>")], "article_id long, start int, end int, entity_id string")
    words = sorted(map(tuple, exports.words_file(sents, mentions).collect()))
    assert ("<http://www.wikidata.org/entity/Q1>", 1, 0, 1) in words and len(words) == 6
    af = exports.articles_file(sents, spark.createDataFrame([(10, 8)], "id long, abstract_end int"), spark.createDataFrame([(10, "u")], "id long, url string"))
    assert sorted((r.record, r.is_abstract) for r in af.collect()) == [(0, 1), (1, 0), (2, 0), (3, 0)]


def test_splits(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    preset = spark.createDataFrame([(1, "dev"), (2, "test")], "k long, split string")
    got = {r.k: r.split for r in splits.fixed_size(df, "k", 20, 30, preset=preset).collect()}
    assert got[1] == "dev" and got[2] == "test" and list(got.values()).count("dev") == 20 and list(got.values()).count("test") == 30
    arts = spark.createDataFrame([(i, "\n\n".join(f"para {j}" for j in range(i % 6 + 1))) for i in range(30)], "id long, text string")
    for r in splits.paragraph_window(arts).collect():
        assert r.text[r.begin : r.stop].count("para") == min(3, r.id % 6 + 1)


def test_vectors_and_network(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    net = ml.TwoLayers(hidden=8, epochs=30).fit(x[:300], y[:300], x[300:], y[300:])
    df = spark.createDataFrame([(i // 4, i, f"Q{i}", v.tolist(), float(t), 0.1) for i, (v, t) in enumerate(zip(x, y, strict=True))], "m long, item long, entity_id string, f array<double>, y double, prior double")
    out = ml.scored(df, "f", net)
    assert ml.threshold_accuracy(out, F.col("y"), F.col("score")).first().accuracy > 0.9
    assert ml.best_candidate(out, ["m"]).count() == 100
    assert ml.group_accuracy(out, "m", "y", ["score"]).first().random == 0.25
    v = ml.entity_vectors(spark.createDataFrame([("Q0",), ("Q?",)], ["entity_id"]), spark.createDataFrame([("Q0", [1.0, 2.0])], "entity_id string, vector array<double>"), 2).collect()
    assert {r.entity_id: len(r.vector) for r in v} == {"Q0": 2, "Q?": 2} and all(-1 < c < 1 for r in v if r.entity_id == "Q?" for c in r.vector)
    mean = ml.assembled(ml.vector_mean(df, "m", "f"), "m").where("m = 0").first().vector
    assert np.allclose(mean, x[:4].mean(0))


def test_reports(spark):
    rows = spark.createDataFrame([("b", "x"), ("a", "-"), ("c", "10"), ("d", "9")], "n string, v string")
    assert [r.n for r in report.sorted_by(rows, "v").collect()][:2] == ["c", "d"]
    assert [r.n for r in report.configured_order(rows, "n", ["c", "a"]).collect()] == ["c", "a", "b", "d"]
    e = spark.createDataFrame([("Good", "one", "x"), ("Old deprecated", "one", "y")], "experiment string, benchmark string, category string")
    assert [r.experiment for r in report.shown(e).collect()] == ["Good"] and report.hidden(e, ["x"]).count() == 1
    labels = spark.createDataFrame([("b", None, "Q1", False, False, "Two words"), ("b", 0, "<NIL>", True, False, "low")], "benchmark string, parent int, entity_id string, optional boolean, coref boolean, text string")
    assert tuple(report.benchmark_statistics(labels).first())[1:] == (2, 0.5, 0.5, 0.0, 0.5, 0.5)
    assert report.benchmark_statistics(labels, True).first().labels == 1


def test_capitalised_runs_are_whole(spark):
    """A name of any number of words is one span; a very long run too."""
    name, run = "United Nations High Commissioner Refugees Office", " ".join(["Ab"] * 5000)
    docs = spark.createDataFrame([(1, f"the {name} met Bob"), (2, run + " x")], "id long, text string")
    got = sorted((r.article_id, r.start, r.end, r.text) for r in linking.capitalised_spans(docs).collect())
    assert got == [(1, 4, 4 + len(name), name), (1, 9 + len(name), 12 + len(name), "Bob"), (2, 0, len(run), run)]


def test_stream(spark, tmp_path):
    import json

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"id": i, "title": "t", "text": "Anna met Bob"}) + "\n")
    stream = annotate.article_stream(spark, str(tmp_path / "in"), 1)
    annotate.annotate(stream, linking.capitalised_spans, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 6 and {r.text for r in got.collect()} == {"Anna", "Bob"}
