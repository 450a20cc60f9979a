"""The command line from end to end on a small corpus."""

import json
import pickle

import pytest

from loomspan import cli

TEXT = "Ann Lee moved to Paris. Ann liked Paris."


@pytest.fixture
def corpus(spark, tmp_path):
    label = lambda i, s, e, q, n, t: {"id": i, "span": [s, e], "entity_id": q, "name": n, "type": t, "parent": None, "children": []}
    arts = [{"id": 1, "title": "Ann Lee", "text": TEXT, "hyperlinks": [[[17, 22], "Paris"]], "evaluation_span": [0, 40], "labels": [label(0, 0, 7, "Q1", "Ann Lee", "Q5"), label(1, 17, 22, "Q2", "Paris", "Q486972")]}]
    (tmp_path / "a.jsonl").write_text("".join(json.dumps(x) + "\n" for x in arts))
    k = tmp_path / "k"
    spark.createDataFrame([("Ann Lee", "Q1"), ("Paris", "Q2")], "title string, entity_id string").write.parquet(str(k / "titles"))
    spark.createDataFrame([("Q1", ["Q5"]), ("Q2", ["Q486972"])], "entity_id string, types array<string>").write.parquet(str(k / "types"))
    spark.createDataFrame([("Q1", "Ann Lee"), ("Q2", "Paris")], "entity_id string, name string").write.parquet(str(k / "names"))
    (tmp_path / "w").write_text("Q5\thuman\nQ486972\tplace\n")
    return tmp_path


def lines(folder):
    return [x for p in sorted(folder.glob("part-*")) for x in p.read_text().splitlines()]


def test_link_and_evaluate(corpus, capsys):
    c = str(corpus)
    assert cli.main(["link", f"{c}/a.jsonl", f"{c}/linked", "--linker", "hyperlink-reference", "--knowledge", f"{c}/k", "--evaluation-span"]) == 0
    linked = json.loads(lines(corpus / "linked")[0])
    assert {(TEXT[m["span"][0] : m["span"][1]], m["id"]) for m in linked["entity_mentions"]} >= {("Ann Lee", "Q1"), ("Paris", "Q2")}
    cli.main(["evaluate", f"{c}/linked", f"{c}/eval", "--knowledge", f"{c}/k", "--whitelist", f"{c}/w"])
    result = json.loads(lines(corpus / "eval" / "results")[0])
    assert result["REQUIRED"]["mention_types"]["all"]["recall"] == 1 and result["IGNORED"]["entity_types"]["Q5"]["true_positives"] == 1
    errors = result["REQUIRED"]["error_categories"]
    assert errors["ner_fn"]["all"] == {"errors": 0, "total": result["REQUIRED"]["error_categories"]["ner"]["ground_truth"]}
    assert errors["ner_fp"]["all"]["total"] == errors["ner_fp"]["lowercased"]["total"] + errors["ner_fp"]["other"]["total"] > 0
    assert errors["wrong_disambiguation"]["all"] == {"errors": 0, "total": errors["ner"]["true_positives"]}
    assert set(errors["wrong_coreference"]) == {"undetected", "false_detection"} and set(errors["other_errors"]) == {"hyperlink"}
    assert len(json.loads(lines(corpus / "eval" / "cases")[0])) >= 2
    cli.main(["export", f"{c}/linked", f"{c}/words", f"{c}/docs"])
    assert "1\tAnn liked Paris." in [x.replace("\t ", "\t") for x in lines(corpus / "docs")] and len(lines(corpus / "words")) > 8
    cli.main(["render", f"{c}/linked", f"{c}/text", "--mode", "labels"])
    assert "[Q1:Ann Lee|Ann Lee] moved to [Q2:Paris|Paris]. Ann liked Paris." in lines(next((corpus / "text").glob("article=*")))


def test_oracle_linker_is_perfect(corpus):
    c = str(corpus)
    cli.main(["link", f"{c}/a.jsonl", f"{c}/gold", "--linker", "oracle", "--knowledge", f"{c}/k"])
    cli.main(["evaluate", f"{c}/gold", f"{c}/eval"])
    result = json.loads(lines(corpus / "eval" / "results")[0])
    assert all(m["f1"] == 1 for mode in result.values() for m in mode["mention_types"].values())
    other = json.loads((corpus / "a.jsonl").read_text())
    other["labels"] = other["labels"][:1]
    (corpus / "b.jsonl").write_text(json.dumps(other) + "\n")
    cli.main(["evaluate", f"{c}/gold", f"{c}/a.jsonl", f"{c}/both", "--benchmark", f"{c}/b.jsonl", "--write-back"])
    one, none = (json.loads(lines(corpus / "both" / name / "results")[0])["REQUIRED"]["mention_types"]["all"] for name in ("gold", "a.jsonl"))
    assert (one["true_positives"], one["false_positives"], none["recall"], none["ground_truth"]) == (1, 1, 0, 1)
    assert len(json.loads(lines(corpus / "both" / "gold" / "articles")[0])["labels"]) == 1
    with pytest.raises(SystemExit):
        cli.main(["evaluate", f"{c}/gold", f"{c}/x/gold", f"{c}/both"])


def test_other_commands(corpus, spark):
    c = str(corpus)
    (corpus / "kv").write_text("a\tx;y\nb\ty\n")
    cli.main(["keyvalue", f"{c}/kv", f"{c}/kvout", "--method", "multi", "--inverse", "--separator", ";"])
    kept = lambda: {r.key: r.value for r in spark.read.parquet(f"{c}/kvout").collect()}
    assert kept() == {"x": "a", "y": "a,b"}
    (corpus / "urls").write_text("a\thttps://en.wikipedia.org/wiki/A_b\thttps://en.wikipedia.org/wiki/C\n")
    cli.main(["keyvalue", f"{c}/urls", f"{c}/kvout", "--separator", "tab", "--names"])
    assert kept() == {"a": "A b\tC"}
    (corpus / "counts").write_bytes(pickle.dumps({"t": {"Q1": 1, "Q3": 2, "Q2": 2}, "none": {}}))
    cli.main(["keyvalue", f"{c}/counts", f"{c}/kvout", "--method", "popular"])
    assert kept() == {"t": "Q3,Q2"}
    (corpus / "raw").write_text("one two\ntwo\n")
    cli.main(["unigrams", f"{c}/raw", f"{c}/uni", "--raw"])
    assert lines(corpus / "uni") == ["one 1", "two 2"]
    cli.main(["link", f"{c}/raw", f"{c}/rawout", "--raw", "--linker", "baseline", "--knowledge", f"{c}/k"])
    assert len(lines(corpus / "rawout")) == 2
    (corpus / "ann").write_text("**** ARTICLE 1\nA [Q1:N|b] c.\n**** ARTICLE 2\nskip\n")
    cli.main(["benchmark", f"{c}/ann", f"{c}/bench", "--skip", "2"])
    rows = [json.loads(x) for x in lines(corpus / "bench")]
    assert len(rows) == 1 and rows[0]["text"] == "A b c.\n" and rows[0]["labels"][0]["entity_id"] == "Q1"


def test_wrong_arguments(corpus):
    with pytest.raises(SystemExit):
        cli.main(["link", "a", "b", "--knowledge", "k"])
