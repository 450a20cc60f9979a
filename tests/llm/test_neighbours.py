import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import neighbours
from loomspan.llm import queries as q

SF = "/root/testdata/sf0.001"


def brute(ids, x, queries, k=10):
    out = []
    for i, v in zip(ids, x, strict=True):
        if queries(i):
            d = np.sqrt(((x - v) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out += [(i, r + 1, ids[j], d[j]) for r, j in enumerate(order)]
    return sorted(out)


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=1e-12)


def test_query(spark):
    rows = q._read(spark, SF, "embeddings").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    want = brute(np.array([r.vec_id for r in rows]), x, lambda i: i % 100 == 0)
    same(sorted(tuple(r) for r in q.op7_nearest_neighbours(spark, SF).collect()), want)


@pytest.mark.parametrize("tiles", [(16_384, 2_048), (7, 3)])
def test_edges(spark, tiles):
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(size=(30, 5)), np.ones((20, 5)), rng.normal(size=(5, 5)) * 1e6]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())]
    odd = [(90, None), (91, []), (92, [0.0] * 5), (93, [1.0, None, 0.0, 0.0, 0.0]), (94, [float("nan")] * 5), (95, [float("inf")] + [0.0] * 4), (96, [1.0, 2.0]), (None, [1.0] * 5)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash"))
    got = neighbours.search(df, F.col("vec_id") % 2 == 0, 10, *tiles)
    same(sorted(tuple(r) for r in got.collect()), brute(np.arange(len(x)), x, lambda i: i % 2 == 0))
    few = neighbours.search(df.where("vec_id < 4 or vec_id > 89"), F.col("vec_id") == 2, 10, *tiles).collect()
    assert sorted(r.vec_id for r in few) == [0, 1, 3]
    assert neighbours.search(df.limit(0), F.col("vec_id") >= 0).count() == 0


def test_far_shells_are_left_out(spark):
    """On clusters a query meets its own surroundings only: a small part of all pairs meets, and nothing is lost."""
    rng = np.random.default_rng(3)
    pairs = {}
    for n in (1000, 4000):
        centre = rng.normal(size=(n // 50, 8)) * 100
        x = centre[np.arange(n) % len(centre)] + rng.normal(size=(n, 8))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        q_, c = neighbours.tiles(df, F.col("vec_id") % 20 == 0, 10, 64, 32, pivot_rows=20)
        met = q_.groupBy("shell", "i", "j").agg(F.count("*").alias("a")).join(c.groupBy("shell", "i", "j").agg(F.count("*").alias("b")), ["shell", "i", "j"])
        pairs[n] = met.agg(F.sum(F.col("a") * F.col("b"))).first()[0]
        got = neighbours.search(df, F.col("vec_id") % 20 == 0, 10, 64, 32, pivot_rows=20)
        same(sorted(tuple(r) for r in got.collect()), brute(np.arange(n), x, lambda i: i % 20 == 0))
    assert all(pairs[n] < 0.1 * n * n / 20 for n in pairs)


def test_several_vectors_of_one_id(spark):
    """A query meets no row of its own id, however many there are, and still finds k others."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    ids = np.r_[np.zeros(30, int), np.arange(1, 271)]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("vec_id") == 5, 10, 16, 4, pivot_rows=10).collect()
    at = int(np.flatnonzero(ids == 5)[0])
    want = [w for w in brute(ids, x, lambda i: i == 5)]
    assert sorted(r.vec_id for r in got) == sorted(w[2] for w in want) and at > 0
