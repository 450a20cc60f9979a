"""Readers and writers: round trips and odd lines."""

import json
import pickle
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomspan.sources import readers, writers
from loomspan.sources.ordinal import with_ordinal

ARTICLES = [
    {"id": 7, "title": 'A "quoted" title', "text": "a😀bc Paris's text\n", "hyperlinks": [[[5, 10], "Paris"]], "title_synonyms": [[0, 4]], "evaluation_span": [0, 5],
     "labels": [{"id": 0, "span": [5, 10], "entity_id": "Q90", "name": "Paris", "type": "Q486972|Q5", "parent": None, "children": []}]},
    {"id": 3, "title": "No mentions", "text": ""},
]


@pytest.fixture
def path(tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text("".join(json.dumps(a) + "\n" for a in ARTICLES))
    return str(f)


def test_articles_round_trip(spark, path, tmp_path):
    df = readers.articles(spark, path)
    rows = df.orderBy("ordinal").collect()
    assert [r.id for r in rows] == [7, 3] and rows[1].hyperlinks == []
    assert rows[0].hyperlinks[0].target == "Paris" and rows[0].labels[0].start == 5 and rows[0].labels[0].optional is False
    writers.linked_articles(df, str(tmp_path / "out"))
    again = readers.articles(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.drop("ordinal").collect())) == sorted(map(str, df.drop("ordinal").collect()))
    assert readers.articles(spark, path, 1).count() == 1


def test_rewritten(spark, path, tmp_path):
    df = readers.articles(spark, path)
    writers.rewritten(df, df.where("id = 3").withColumn("title", F.lit("New")), str(tmp_path / "new"))
    assert {r.id: r.title for r in readers.articles(spark, str(tmp_path / "new")).collect()} == {7: 'A "quoted" title', 3: "New"}


def test_raw_texts_and_key_values(spark, tmp_path):
    (tmp_path / "t.txt").write_text("first\nsecond\n")
    assert [tuple(r) for r in readers.raw_texts(spark, str(tmp_path / "t.txt")).orderBy("id").collect()] == [(0, 0, "", "first"), (1, 1, "", "second")]
    (tmp_path / "kv.tsv").write_text('k"1\ta;b,c\nplain\nk2\t"x\ty"\n')
    assert [(r.key, r.value) for r in readers.key_values(spark, str(tmp_path / "kv.tsv")).orderBy("ordinal").collect()] == [('k"1', "a;b,c"), ("k2", '"x\ty"')]


def test_pickled_mapping(spark, tmp_path):
    f = tmp_path / "m.pkl"
    f.write_bytes(pickle.dumps({"a": {"y", "x"}, "b": "one"}))
    assert {r.key: r.values for r in readers.pickled_mapping(spark, str(f)).collect()} == {"a": ["x", "y"], "b": ["one"]}
    f.write_bytes(pickle.dumps(datetime(2020, 1, 1)))
    with pytest.raises(pickle.UnpicklingError):
        readers.pickled_mapping(spark, str(f))


def test_triples_and_lists(spark, tmp_path):
    (tmp_path / "g.nt").write_text('# c\n<http://x/a> <http://x/p> <http://x/b> .\n<http://x/a> <http://x/n> "N\\"m"@en .\n<http://x/a> <http://x/i> "5"^^<http://x/int> .\nwd:Q1 wdt:P31 wd:Q5 .\n')
    got = {tuple(r) for r in readers.triples(spark, str(tmp_path / "g.nt")).collect()}
    assert got == {("http://x/a", "http://x/p", "http://x/b"), ("http://x/a", "http://x/n", 'N\\"m'), ("http://x/a", "http://x/i", "5"), ("wd:Q1", "wdt:P31", "wd:Q5")}
    (tmp_path / "w.tsv").write_text("Q5\thuman\n\nno id\nQ5 again Q7\n")
    assert [r.type_id for r in readers.whitelist(spark, str(tmp_path / "w.tsv")).collect()] == ["Q5"]
    (tmp_path / "c.txt").write_text("# heading\n\nADD wd:Q1 wdt:P279 wd:Q2  # why\nREMOVE wd:Q3 wdt:P31 wd:Q4\n")
    assert {tuple(r) for r in readers.corrections(spark, str(tmp_path / "c.txt")).collect()} == {("ADD", "Q1", "P279", "Q2"), ("REMOVE", "Q3", "P31", "Q4")}
    (tmp_path / "j.txt").write_text("Q1 REPLACE_WITH Q2\nQ3 MINUS Q4\n")
    assert readers.adjustments(spark, str(tmp_path / "j.txt")).count() == 2


def test_benchmarks_and_results(spark, tmp_path):
    for n in ("one", "two"):
        (tmp_path / f"{n}.benchmark.jsonl").write_text(json.dumps(ARTICLES[0]) + "\n")
    assert readers.benchmarks(spark, str(tmp_path), ["ALL"]).count() == 2
    assert [r.benchmark for r in readers.benchmarks(spark, str(tmp_path), ["two"]).collect()] == ["two"]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "sys.one.eval_results.json").write_text('{"IGNORED": {"mention_types": {"all": {"f1": 0.5}}, "error_categories": {"ner_fp": {"all": 3, "x": {"errors": 1, "total": null}}}}}')
    (tmp_path / "r" / "sys.one.metadata.json").write_text("{}")
    found = readers.results(spark, str(tmp_path / "r"))
    assert {(r.experiment_id, r.kind) for r in found.collect()} == {("sys.one", "eval_results"), ("sys.one", "metadata")}
    from loomspan.plans import report

    flat = {(r.category, r.sub): r.value for r in report.flattened(found.where("kind = 'eval_results'")).collect()}
    assert flat == {("all", "f1"): 0.5, ("ner_fp", "all"): 3.0, ("ner_fp", "x.errors"): 1.0, ("ner_fp", "x.total"): None}


def test_statistics_file(spark, tmp_path):
    (tmp_path / "s").write_text("{stats}\ncase1\ncase2\n\nrest\n")
    head, cases = readers.statistics_file(spark, str(tmp_path / "s"))
    assert [r.value for r in head.collect()] == ["{stats}"] and sorted(r.value for r in cases.collect()) == ["case1", "case2"]


def test_annotated_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("intro\n**** ARTICLE 1\n<START>\nText [Q1:A|one].\n<END>\n**** ARTICLE 2\nMore\n")
    rows = readers.annotated_text(spark, str(tmp_path / "a.txt")).orderBy("number").collect()
    assert [(r.header, r.body) for r in rows] == [("**** ARTICLE 1", "Text [Q1:A|one].\n"), ("**** ARTICLE 2", "More\n")]


def test_predictions(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"id": 1, "predictions": [{"start_char": 0, "end_char": 3, "entity_reference": "Q1"}]}\n')
    assert [tuple(r) for r in readers.predictions_jsonl(spark, str(tmp_path / "p.jsonl")).collect()] == [(1, 0, 3, "Q1")]
    n = "http://persistence.uni-leipzig.org/nlp2rdf/ontologies/nif-core#"
    rows = [("a", f"{n}beginIndex", "2"), ("a", f"{n}endIndex", "5"), ("a", "http://www.w3.org/2005/11/its/rdf#taIdentRef", "http://www.wikidata.org/entity/Q3"), ("a", f"{n}referenceContext", "doc")]
    assert [tuple(r) for r in readers.predictions_nif(spark.createDataFrame(rows, ["s", "p", "o"])).collect()] == [("doc", 2, 5, "Q3")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "token string, n int")
    writers.unigrams(df, str(tmp_path / "u"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "u").glob("part-*"))) == "a 1\nb 2\n"
    kv = spark.createDataFrame([("k", "v"), ("", "x"), ("y" * 600, "z")], "key string, value string")
    writers.key_value_table(kv, str(tmp_path / "kv"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "kv")).collect()] == [("k", "v")]
    cases = spark.createDataFrame([(1, 5, "b"), (1, 0, "a"), (0, 2, "c")], "article_id long, start int, text string")
    writers.eval_cases(cases, str(tmp_path / "c"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part-*"))).splitlines()
    assert [[x["text"] for x in json.loads(line)] for line in lines] == [["c"], ["a", "b"]]
    arts = spark.createDataFrame([(0, "A/B c", "text")], "ordinal long, title string, text string")
    writers.article_files(arts, str(tmp_path / "f"), titles=True)
    assert [p.name for p in (tmp_path / "f").iterdir() if p.is_dir()] == ["article=article_00000_A_B_c"]
    assert writers.latex_rows(df.orderBy("token")) == ["token & n \\\\", "\\hline", "a & 1 \\\\", "b & 2 \\\\"]
    assert writers.spanned_header([("x", 2), ("y", 1)]) == "x\t\ty"
    meta = json.loads(writers.metadata("e", "d", "l", 1.5, datetime(2024, 2, 3, 4, 5)))
    assert meta["timestamp"] == "2024/02/03 04:05"
    metrics = spark.createDataFrame([("IGNORED", "mention_types", "all", "f1", 1.0)], "mode string, base string, category string, metric string, value double")
    assert json.loads(writers.nested_results(metrics)) == {"IGNORED": {"mention_types": {"all": {"f1": 1.0}}}}


def test_ordinals_are_contiguous(spark):
    df = spark.range(1000).repartition(7)
    got = with_ordinal(df, "n", "id").collect()
    assert sorted((r.n, r.id) for r in got) == [(i, i) for i in range(1000)]
    assert sorted(r.n for r in with_ordinal(df, "n").collect()) == list(range(1000))


def test_predictions_of_services(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "article_7.json").write_text(json.dumps({"matches": [{"charOffset": 2, "charLength": 3, "entity": {"id": "http://www.wikidata.org/entity/Q5"}}, {"charOffset": 9, "charLength": 1, "entity": {}}]}))
    assert [tuple(r) for r in readers.predictions_ambiverse(spark, str(tmp_path / "a")).collect()] == [(7, 2, 5, "Q5")]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "3.json").write_text(json.dumps({"annotations": [{"wikiDataItemId": "Q1", "support": [{"chFrom": 0, "chTo": 4}]}, {"wikiDataItemId": "Q2", "support": [{"chFrom": 0, "chTo": 4}, {"chFrom": 6, "chTo": 8}]}, {"support": [{"chFrom": 1, "chTo": 2}]}]}))
    assert sorted(tuple(r) for r in readers.predictions_wikifier(spark, str(tmp_path / "w")).collect()) == [(3, 0, 5, "Q1"), (3, 6, 9, "Q2")]


def test_page_addresses(spark):
    m = spark.createDataFrame([("Q1", 0, 2), ("Q9", 3, 4), ("<NIL>", 5, 6), (None, 7, 8)], "entity_id string, start int, end int")
    titles = spark.createDataFrame([("A/b ~*é", "Q1")], "title string, entity_id string")
    got = [r.entity_uri for r in writers.nif_annotations(m, F.lit("c"), titles=titles).collect()]
    assert got == ["https://en.wikipedia.org/wiki/A/b_~%2A%C3%A9", *["http://example.org/unknown"] * 3]
