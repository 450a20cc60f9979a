"""Nested bracket annotations [TAG:QID:name|text] to labels, article by article, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# The tags of the format.
TAGS = ("OPTIONAL", "DESC", "COREF", "NO_COREF_ALT")
# Labels that are values, not entities; they are their own type.
VALUES = ("DATETIME", "QUANTITY")
_OPEN = re.compile(r"\[((?:(?:OPTIONAL|DESC|COREF|NO_COREF_ALT):)*)(Q[0-9]+|<NIL>|Unknown[^:|\]]*|DATETIME|QUANTITY)(?::([^|\]\[]*))?\|")
SCHEMA = "article_id long, text string, id int, start int, end int, entity_id string, name string, parent int, children array<int>, optional boolean, desc boolean, coref boolean, no_coref_alt boolean, type string"


def parse(body: str) -> tuple[str, list[dict]]:
    """Plain text and labels (ids in opening order, offsets in the plain text). Brackets of other kinds stay text."""
    out, labels, stack, at, size = [], [], [], 0, 0
    while at < len(body):
        m = _OPEN.match(body, at) if body[at] == "[" else None
        if m:
            tags = set(filter(None, m[1].split(":")))
            kind = m[2] if m[2] in VALUES else "OTHER"
            entity = "<NIL>" if m[2].startswith("Unknown") else m[2]
            label = {"id": len(labels), "start": size, "entity_id": entity, "name": m[3] or "", "parent": stack[-1]["id"] if stack else None, "children": [], "type": kind}
            label |= {t.lower(): t in tags for t in TAGS}
            if stack:
                stack[-1]["children"].append(label["id"])
            labels.append(label)
            stack.append(label)
            at = m.end()
        elif body[at] == "[" and stack:
            stack.append({"id": stack[-1]["id"], "children": stack[-1]["children"], "plain": True})
            out.append("[")
            at, size = at + 1, size + 1
        elif body[at] == "]" and stack:
            top = stack.pop()
            if top.get("plain"):
                out.append("]")
                size += 1
            else:
                top["end"] = size
            at += 1
        else:
            out.append(body[at])
            at, size = at + 1, size + 1
    for label in stack:
        label["end"] = size
    return "".join(out), [x for x in labels if "end" in x]


def delete(labels: list[dict], drop: set[int]) -> list[dict]:
    """Without the dropped labels; their children move up to the nearest label that stays."""
    by = {x["id"]: x for x in labels}

    def up(i):
        while i is not None and i in drop:
            i = by[i]["parent"]
        return i

    kept = [x | {"parent": up(x["parent"]), "children": []} for x in labels if x["id"] not in drop]
    for x in kept:
        if x["parent"] is not None:
            next(y for y in kept if y["id"] == x["parent"])["children"].append(x["id"])
    return sorted(kept, key=lambda x: x["id"])


def labels(articles: DataFrame, coreference: bool = True) -> DataFrame:
    """article_id, body -> one row a label (SCHEMA). Unknown entities are <NIL>; the type is DATETIME, QUANTITY or OTHER.

    A benchmark with coreference has no labels that are alternatives for the case without (NO_COREF_ALT); one without
    ``coreference`` has those, but none tagged COREF. What is taken out leaves its children to the label above.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for frame in frames:
            rows = []
            for article, body in zip(frame.article_id, frame.body, strict=True):
                text, found = parse(body or "")
                found = delete(found, {x["id"] for x in found if x["no_coref_alt" if coreference else "coref"]})
                rows += [x | {"article_id": article, "text": text} for x in found]
            yield pd.DataFrame(rows, columns=names).astype({"parent": "Int32"})

    return articles.select("article_id", "body").mapInPandas(run, SCHEMA)
