"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a stated lexicon and of words learned from labels, their closeness to
second-person words, capitals, punctuation, and obfuscation (digits and symbols within words, spaced
letters, and lexicon words found only after undoing that). Every document is scored by one pass in Arrow
batches; the model is small and travels with the tasks.

Training uses labelled rows only, at most MAX_LABELLED of them (the smallest by MD5 of doc_id; a
documented bound): four tenths teach the learned words, six tenths the trees; the calibration is fitted on
scores of those six tenths that trees without the scored third gave, so that no part is judged on rows that
shaped it. With few toxic rows, leaves may be as small as their number and the thirds are dealt by class. Only if
the rows of the trees are all of one class, or none, is the score a fixed function of the stated lexicon.

Defined results: null and empty texts have all features zero and get a score; repeated rows score alike; a null
doc_id is never held out; labels that are null are left out, and a doc_id labelled twice counts as toxic
if any row says so, and if it has several texts the least of them teaches; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import tidy
from .boosting import Boosted, isotonic

MAX_LABELLED, LEAST_LEAF = 20_000, 20

# Insults and other words of abuse.
LEXICON = frozenset(
    """idiot idiots idiotic stupid moron morons trash scum loser losers pathetic worthless disgusting clown clowns
    dumb fool fools jerk garbage filth filthy vermin shit shitty fuck fucking bitch bastard asshole crap damn hate
    ugly retard retarded whore slut pig coward liar freak creep dumbass imbecile kill die idiota estupido basura
    dumm idiotin abschaum arschloch widerlich connard merde salaud imbécile""".split()
)
# Second-person words.
SECOND = frozenset("you your yours yourself u ur youre du dich dir dein deine ihr euch tu toi te vous votre tes usted ustedes ti tus".split())
# What digits and symbols stand for within words.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
WORD = re.compile(r"[^\W\d_]+")
MIXED = re.compile(r"(?<!\S)[^\W\d_]*(?:[0-9@$!*.\-_]{1,3}[^\W\d_]+)+[0-9$]?")
SPACED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][ .\-*_]){2,}[^\W\d_](?![^\W\d_])")
NEAR = 5

NAMES = [
    "log_words", "hits", "hit_density", "learned", "learned_density", "near_second", "second_density", "capitals",
    "shouted", "exclaim", "punctuation", "runs", "mixed", "undone", "symbols", "digits",
]


def features(text: str | None, learned: frozenset[str] = frozenset()) -> list[float]:
    text = text or ""
    if not text:
        return [0.0] * len(NAMES)
    low = text.lower()
    words = WORD.findall(low)
    n, chars = max(1, len(words)), len(text)
    at = [i for i, w in enumerate(words) if w in LEXICON]
    own = sum(w in learned for w in words) if learned else 0
    second = [i for i, w in enumerate(words) if w in SECOND]
    near = int((np.abs(np.subtract.outer(at, second)).min(axis=1) <= NEAR).sum()) if at and second and len(at) * len(second) < 10_000 else _near(at, second)
    mixed = [m for m in MIXED.findall(low) if any(c in "013457@$!*.-_" for c in m.rstrip(".!-"))]
    undone = sum(_plain(m) in LEXICON for m in mixed) + sum(_plain(m) in LEXICON for m in SPACED.findall(low))
    upper = sum(map(str.isupper, text)) if text != low else 0
    shouted = len(re.findall(r"\b[A-Z]{3,}\b", text)) if upper else 0
    exclaim, question = text.count("!"), text.count("?")
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    runs = len(re.findall(r"[!?.*#$%&]{2,}", text))
    digits = sum(text.count(c) for c in "0123456789")
    dots = text.count(".") + text.count(",") + exclaim + question
    return [
        float(np.log1p(len(words))), float(len(at)), 100 * len(at) / n, float(own), 100 * own / n, float(near),
        100 * len(second) / n, upper / chars, 100 * shouted / n, 100 * (exclaim + question) / n, dots / chars, 100 * runs / n,
        100 * len(mixed) / n, float(undone), symbols / chars, digits / chars,
    ]


def _near(at: list[int], second: list[int]) -> int:
    if not at or not second:
        return 0
    a, s = np.array(at), np.array(second)
    k = np.searchsorted(s, a)
    gap = np.minimum(np.abs(a - s[np.minimum(k, len(s) - 1)]), np.abs(a - s[np.maximum(k - 1, 0)]))
    return int((gap <= NEAR).sum())


def _plain(word: str) -> str:
    return re.sub(r"[^\w]|_", "", word.translate(LEET))


def _mapped(docs: DataFrame, keep: list[str], learned: frozenset[str]) -> DataFrame:
    """``keep`` and x (array<float>), from column text."""
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t, learned) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(x, pa.list_(pa.float64()))], names=schema.names)

    return docs.select(*keep, "text").mapInArrow(tidy(run), schema)


def _fold(doc_id: Column) -> Column:
    """0 to 9, unrelated to the held-out fifth."""
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(10))


def _learn_words(docs: DataFrame) -> frozenset[str]:
    """Words much more frequent in toxic rows; as each is in several of at most MAX_LABELLED rows, their number is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, toxic = [], []
            for t, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = set(WORD.findall((t or "").lower()))
                word += own
                toxic += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(toxic, pa.int32())], names=["word", "toxic"])

    totals = docs.agg(F.sum("toxic"), F.count("*")).first()
    if not totals[0]:
        return frozenset()
    bad, good = totals[0], max(1, totals[1] - totals[0])
    counts = docs.select("text", "toxic").mapInArrow(run, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    ratio = ((F.col("t") + 0.5) / bad) / ((F.col("n") - F.col("t") + 0.5) / good)
    return frozenset(r.word for r in counts.where((F.col("t") >= max(5, bad // 50)) & (ratio > 8)).collect())


class Model:
    def __init__(self, learned=frozenset(), trees: Boosted | None = None, knots=None):
        self.learned, self.trees, self.knots = learned, trees, knots

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            hits = x[:, NAMES.index("hits")] + x[:, NAMES.index("undone")]
            return 1 - 1 / (1 + hits * (0.5 + 0.5 * (x[:, NAMES.index("near_second")] > 0)) + 0.02)
        raw = self.trees.raw(x)
        rate = np.interp(raw, *self.knots)
        return np.clip(0.998 * rate + 0.002 / (1 + np.exp(-raw)), 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on the given labelled rows (doc_id, toxic); at most ``max_labelled`` take part."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(max_labelled)
    known = known.select(F.col("doc_id").alias("_id"), "toxic", _fold(F.col("doc_id")).alias("fold"))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    rows = rows.groupBy("doc_id", "toxic", "fold").agg(F.min("text").alias("text"))  # of rows that repeat an id, one teaches
    learned = _learn_words(rows.where("fold < 4"))
    found = _mapped(rows.where("fold >= 4"), ["doc_id", "toxic", "fold"], learned).collect()
    if not found:
        return Model(learned)
    found.sort(key=lambda r: str(r.doc_id))
    x, y, fold = (np.array([r[c] for r in found], float) for c in ("x", "toxic", "fold"))
    if not 0 < y.sum() < len(y):
        return Model(learned)
    part = fold % 3
    if any(not 0 < y[part == k].sum() < (part == k).sum() for k in range(3)):
        for c in (0, 1):
            part[y == c] = (np.arange((y == c).sum()) + c) % 3
    least = int(np.clip(y.sum(), 2, LEAST_LEAF))
    raw = np.zeros(len(y))
    for k in range(3):
        raw[part == k] = Boosted(least=least).fit(x[part != k], y[part != k]).raw(x[part == k])
    return Model(learned, Boosted(least=least).fit(x, y), isotonic(raw, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every document."""
    schema = T.StructType([docs.select("doc_id").schema[0], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t, model.learned) for t in batch.column("text").to_pylist()], float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
