"""Toxicity: features, trees, calibration, held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import queries as q
from loomspan.llm import toxicity as tx
from loomspan.llm.boosting import Boosted, isotonic


def test_features():
    f = dict(zip(tx.NAMES, tx.features("You are an IDIOT, an absolute idiot!!! 1d10t and s.t.u.p.i.d or m o r o n"), strict=True))
    assert f["hits"] == 2 and f["near_second"] >= 1 and f["shouted"] > 0 and f["undone"] >= 2 and f["runs"] > 0
    assert tx.features(None) == tx.features("") == [0.0] * len(tx.NAMES)
    assert len(tx.features("word " * 100_000)) == len(tx.NAMES)
    assert tx._near([], [1]) == 0 and tx._near([10, 50], [14, 100]) == 1


def test_boosting_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5) | (rng.random(3000) < 0.05)).astype(float)
    model = Boosted(trees=60).fit(x[:2000], y[:2000])
    raw = model.raw(x[2000:])
    assert ((raw > 0) == y[2000:]).mean() > 0.93
    xs, ys = isotonic(raw, y[2000:])
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all() and 0 <= ys.min() <= ys.max() <= 1
    p = np.interp(raw, xs, ys)
    assert abs(p.mean() - y[2000:].mean()) < 0.02


def _plain_trees(x, y, trees, depth, rate, least, ridge):
    """Boosting written out node by node: every cut between two values is tried."""
    p = y.mean()
    start = np.log(p / (1 - p))
    raw, grown = np.full(len(y), start), []

    def grow(own, level, g, h):
        best = (1e-9, None, None)
        if level < depth and len(own) >= 2 * least:
            whole = g[own].sum() ** 2 / (h[own].sum() + ridge)
            for f in range(x.shape[1]):
                for cut in np.unique(x[:, f])[:-1]:
                    a, b = own[x[own, f] <= cut], own[x[own, f] > cut]
                    if len(a) >= least and len(b) >= least:
                        gain = g[a].sum() ** 2 / (h[a].sum() + ridge) + g[b].sum() ** 2 / (h[b].sum() + ridge) - whole
                        if gain > best[0] + 1e-12:
                            best = (gain, f, cut)
        if best[1] is None:
            return -rate * g[own].sum() / (h[own].sum() + ridge)
        _, f, cut = best
        return f, cut, grow(own[x[own, f] <= cut], level + 1, g, h), grow(own[x[own, f] > cut], level + 1, g, h)

    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        grown.append(grow(np.arange(len(y)), 0, prob - y, prob * (1 - prob)))
        raw = raw + [value(grown[-1], r) for r in x]
    return lambda rows: np.array([start + sum(value(t, r) for t in grown) for r in rows])


def test_trees_equal_a_plain_version():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (160, 3)).astype(float)
    y = ((x[:, 0] > 6) ^ (x[:, 1] > 8) | (rng.random(160) < 0.1)).astype(float)
    got = Boosted(trees=8, depth=3, least=7).fit(x, y)
    want = _plain_trees(x, y, 8, 3, 0.1, 7, 1.0)
    new = rng.integers(0, 12, (80, 3)).astype(float)
    assert np.allclose(got.raw(x), want(x)) and np.allclose(got.raw(new), want(new))


def test_isotonic_equals_a_plain_version():
    """Without ties, the fit before shrinking is the greatest of the least means over intervals."""
    rng = np.random.default_rng(4)
    score = rng.permutation(60).astype(float)
    y = (rng.random(60) < score / 60).astype(float)
    from loomspan.llm.boosting import _pooled

    order = np.argsort(score)
    pools = _pooled([[float(v), 1.0, s, s] for s, v in zip(score[order], y[order], strict=True)])
    fit = np.repeat([p[0] for p in pools], [int(p[1]) for p in pools])
    t = y[order]
    want = [max(min(t[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    assert np.allclose(fit, want)
    assert (np.diff(isotonic(score, y)[1]) >= 0).all()


def test_repeated_ids_teach_alike(spark):
    """Rows that repeat an id with other texts give the same model in any order."""
    docs = [(i, f"you idiot {i}" if i % 3 == 0 else f"fine words {i}") for i in range(90)] + [(3, "zz"), (3, "aa"), (6, None)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    scores = []
    for rows in (docs, docs[::-1]):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        scores.append(sorted((r.doc_id, r.score) for r in tx.score(df, tx.train(df, labels)).collect()))
    assert scores[0] == scores[1]


def test_query(spark):
    """Held-out rows never teach; the score tells them apart all the same. (sf0.01 has 6 toxic held-out rows: too few to judge.)"""
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in q.op6_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in q._read(spark, sf, "labels").collect()}
    assert len(got) == q._read(spark, sf, "documents").count()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[i].score, t) for i, t in labels.items() if got[i].held_out]
    bad, good = [s for s, t in held if t], [s for s, t in held if not t]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.8, auc


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "you idiot"), (2, ""), (3, "fine words")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0)], "doc_id long, toxic int")
    got = tx.score(docs, tx.train(docs, labels)).collect()
    assert len(got) == 5 and max(got, key=lambda r: r.score).doc_id is None
    assert tx.score(docs.limit(0), tx.train(docs.limit(0), labels.limit(0))).count() == 0


@pytest.mark.parametrize("bound", [100])
def test_sample_is_bounded(spark, bound):
    sf = "/root/testdata/sf0.001"
    model = tx.train(q._read(spark, sf, "documents"), q._read(spark, sf, "labels"), max_labelled=bound)
    assert model.trees is None or len(model.learned) < 1000


def test_trees_teach_at_every_size(spark):
    """Few toxic rows are taught by trees as well; rows of one class leave the lexicon."""
    sf = "/root/testdata/sf0.001"
    docs, labels = q._read(spark, sf, "documents"), q._read(spark, sf, "labels")
    model = tx.train(docs, labels)
    assert model.trees is not None and model.knots is not None and model.trees.leaf.any()
    ids = [r.id for r in spark.range(100).where(tx._fold(F.col("id")) >= 4).orderBy("id").limit(9).collect()]
    texts = spark.createDataFrame([(i, "you idiot " * 5 if k % 3 == 0 else f"fine words {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    for n, toxic, trees in ((9, 3, True), (4, 2, True), (4, 1, True), (2, 1, True), (3, 0, False)):
        marks = spark.createDataFrame([(i, int(k % 3 == 0 and k < 3 * toxic)) for k, i in enumerate(ids[:n])], "doc_id long, toxic int")
        got = tx.train(texts, marks)
        assert (got.trees is not None) == trees, (n, toxic)
        p = [r.score for r in tx.score(texts, got).collect()]
        assert len(p) == 9 and all(0 <= s <= 1 for s in p)
