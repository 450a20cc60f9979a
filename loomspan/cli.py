"""Command line: ``python -m loomspan.cli COMMAND --help``."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from datetime import datetime


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("loomspan").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomspan", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *paths: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text, description=text)
        for path in paths:
            p.add_argument(path)
        return p

    p = command("link", "Link the entities of articles.", "input", "output")
    p.add_argument("--linker", help="one of the registered linkers")
    p.add_argument("--hyperlink-linker", choices=["hyperlinks-only", "hyperlink-reference"])
    p.add_argument("--coreference", help="a registered coreference resolver")
    p.add_argument("--predictions", help="prediction lines instead of a linker")
    p.add_argument("--knowledge", required=True, help="folder of resource tables")
    p.add_argument("--raw", action="store_true", help="the input has one plain text a line")
    p.add_argument("-n", type=int, default=-1, help="first n articles only")
    p.add_argument("--min-score", type=int, default=15)
    p.add_argument("--uppercase", action="store_true", help="no all-lower-case mentions")
    p.add_argument("--evaluation-span", action="store_true")
    p.add_argument("--name", default="experiment")
    p.add_argument("--description", default="")

    p = command("evaluate", "Evaluate linked articles against their labels.")
    p.add_argument("input", nargs="+", help="of several inputs, each has a folder of its name in the output")
    p.add_argument("output")
    p.add_argument("--benchmark", help="articles whose labels, titles and texts take the place of the input's")
    p.add_argument("--write-back", action="store_true", help="write the articles with the benchmark's labels beside the results")
    p.add_argument("--prediction-whitelist", help="file of type ids of the predictions that count")
    p.add_argument("--knowledge", help="folder of resource tables")
    p.add_argument("--whitelist", help="file of type ids")
    p.add_argument("--no-coreference", action="store_true")
    p.add_argument("--no-unknowns", action="store_true")

    p = command("benchmark", "Articles with labels from a bracket-annotated file.", "input", "output")
    p.add_argument("--skip", default="", help="1-based article numbers, space-separated")
    p.add_argument("--no-coref-labels", action="store_true")

    p = command("render", "Write articles as text with annotations.", "input", "output")
    p.add_argument("--mode", choices=["labels", "links", "mentions", "plain"], default="plain")
    p.add_argument("--ascii", action="store_true")
    p.add_argument("--one-line", action="store_true")
    p.add_argument("--titles", action="store_true")

    p = command("export", "Words and sentences files of linked articles.", "input", "words", "docs")
    p.add_argument("--article-records", action="store_true")
    p.add_argument("-n", type=int, default=-1)

    p = command("keyvalue", "Build a key-value table from separated lines.", "input", "output")
    p.add_argument("--method", choices=["single", "multi", "names", "popular"], default="single")
    p.add_argument("--names", action="store_true", help="page addresses become page names")
    p.add_argument("--inverse", action="store_true")
    p.add_argument("--separator", help="between the parts of a value, or the word tab")

    p = command("unigrams", "Count the words of articles.", "input", "output")
    p.add_argument("--raw", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "evaluate" and len({os.path.basename(x.rstrip("/")) for x in a.input}) < len(a.input):
        sys.exit("inputs need different names")
    if a.command == "evaluate" and a.write_back and not a.benchmark:
        sys.exit("give the benchmark whose labels are written back")
    if a.command == "link" and bool(a.linker) == bool(a.predictions) and not a.hyperlink_linker:
        sys.exit("give a linker or predictions (or a hyperlink linker alone)")
    from pyspark.sql import functions as F

    from .operators import exports, mappings
    from .plans import pipelines
    from .sources import readers, writers

    spark, began = _session(), time.time()
    if a.command == "link":
        known = pipelines.knowledge(spark, a.knowledge) | {"min_score": a.min_score, "uppercase": a.uppercase}
        if a.raw:
            empty = spark.read.schema(readers.schema.RAW_ARTICLE).json(spark.sparkContext.parallelize([], 1))
            plain = readers.raw_texts(spark, a.input, a.n)
            arts = readers.schema.normalised(plain.select("ordinal", *[F.col(c) if c in plain.columns else F.lit(None).cast(empty.schema[c].dataType).alias(c) for c in empty.columns]))
        else:
            arts = readers.articles(spark, a.input, a.n)
        found = readers.predictions_jsonl(spark, a.predictions) if a.predictions else None
        out = pipelines.link(arts, known, linker=a.linker, hyperlink_linker=a.hyperlink_linker, coreference=a.coreference, predictions=found)
        writers.linked_articles(pipelines.within_evaluation_span(out) if a.evaluation_span else out, a.output)
        print(writers.metadata(a.name, a.description, a.linker or "predictions", None if a.predictions else time.time() - began, datetime.now()))
    elif a.command == "evaluate":
        known = pipelines.knowledge(spark, a.knowledge) if a.knowledge else None
        types = known["types"] if known else None
        allowed = readers.whitelist(spark, a.whitelist) if a.whitelist else None
        wanted = readers.whitelist(spark, a.prediction_whitelist) if a.prediction_whitelist else None
        for path in a.input:
            target = a.output if len(a.input) == 1 else f"{a.output}/{os.path.basename(path.rstrip('/'))}"
            arts = readers.articles(spark, path)
            if a.benchmark:
                arts = pipelines.relabelled(arts, readers.articles(spark, a.benchmark))
                if a.write_back:
                    writers.linked_articles(arts, f"{target}/articles")
            cases, metrics = pipelines.evaluate(arts, types, allowed, coreference=not a.no_coreference, unknowns=not a.no_unknowns, known=known, wanted=wanted)
            writers.eval_cases(cases, f"{target}/cases")
            result = writers.nested_results(metrics)
            spark.createDataFrame([(result,)], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/results")
            print(json.dumps(json.loads(result)["IGNORED"]["mention_types"].get("all", {})))
    elif a.command == "benchmark":
        out = pipelines.benchmark_from_annotations(spark, a.input, [int(x) for x in a.skip.split()], not a.no_coref_labels)
        out.orderBy("ordinal").write.mode("overwrite").json(a.output)
    elif a.command == "render":
        arts = readers.with_ordinal(readers.articles(spark, a.input).withColumnRenamed("ordinal", "_o"), "ordinal", "_o").drop("_o")
        out = pipelines.rendered(arts, a.mode, a.ascii, a.one_line)
        writers.article_files(out, a.output, a.titles)
    elif a.command == "export":
        arts = readers.articles(spark, a.input, a.n)
        sents = exports.sentences(arts, "article" if a.article_records else "sentence")
        writers.separated(exports.words_file(sents, pipelines.mentions_of(arts)), a.words)
        writers.separated(exports.docs_file(sents), a.docs, order=["record"])
    elif a.command == "keyvalue":
        writers.key_value_table(pipelines.key_value_table(spark, a.input, a.method, a.inverse, "\t" if a.separator == "tab" else a.separator, a.names), a.output)
    elif a.command == "unigrams":
        arts = readers.raw_texts(spark, a.input) if a.raw else readers.articles(spark, a.input)
        writers.unigrams(mappings.unigram_counts(arts), a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
