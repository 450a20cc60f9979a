"""Vector means, group-wise accuracy, and scoring with a small two-layer network."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vector_mean(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, dim, mean: element-wise mean of the vectors of a group, one row a dimension (partial sums before the shuffle)."""
    return rows.select(key, F.posexplode(vector).alias("dim", "x")).groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def assembled(means: DataFrame, key: str) -> DataFrame:
    """key, vector: means put together again (as long as a vector)."""
    rows = F.array_sort(F.collect_list(F.struct("dim", "mean")))
    return means.groupBy(key).agg(F.transform(rows, lambda x: x["mean"]).alias("vector"))


def entity_vectors(entities: DataFrame, vectors: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """entity_id, vector; a missing one is filled with numbers in (-1, 1) that depend on entity and seed only."""
    v = vectors.select(F.col("entity_id").alias("_e"), "vector")
    fill = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.pmod(F.xxhash64(F.col("entity_id"), i, F.lit(seed)), F.lit(1 << 30)) / float(1 << 29) - 1)
    return entities.join(v, F.col("entity_id") == F.col("_e"), "left").select("entity_id", F.coalesce("vector", fill).alias("vector"))


def group_accuracy(scored: DataFrame, group: str, label: str, scores: list[str]) -> DataFrame:
    """n_groups, the share of groups whose row of highest label has the highest score (for each score, named acc_<score>),
    random (1 over the mean group size). Ties go to the smaller item (column item)."""
    best = lambda c: F.max_by("item", F.struct(F.col(c), -F.col("item")))
    g = scored.groupBy(group).agg(F.count("*").alias("n"), best(label).alias("_t"), *[best(s).alias(f"_{s}") for s in scores])
    return g.agg(F.count("*").alias("n_groups"), *[F.avg((F.col(f"_{s}") == F.col("_t")).cast("double")).alias(f"acc_{s}") for s in scores], (1 / F.avg("n")).alias("random"))


def threshold_accuracy(scored: DataFrame, label: Column, score: Column, at: float = 0.5) -> DataFrame:
    """accuracy at a threshold, and that of always answering with the more frequent label."""
    hit = F.avg(((score >= at).cast("int") == label).cast("double"))
    share = F.avg(label.cast("double"))
    return scored.agg(hit.alias("accuracy"), F.greatest(share, 1 - share).alias("majority"))


class TwoLayers:
    """Linear, sigmoid, linear, sigmoid; trained with log loss by mini-batch gradient steps on a bounded sample.

    The weights of the epoch with the lowest validation loss are kept.
    """

    def __init__(self, hidden: int = 32, rate: float = 0.5, epochs: int = 20, batch: int = 64, seed: int = 42):
        self.hidden, self.rate, self.epochs, self.batch, self.seed = hidden, rate, epochs, batch, seed

    @staticmethod
    def _sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def score(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return self._sigmoid(self._sigmoid(x @ a + b) @ c + d)

    def fit(self, x: np.ndarray, y: np.ndarray, x_val: np.ndarray, y_val: np.ndarray) -> TwoLayers:
        rng = np.random.default_rng(self.seed)
        w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], self.hidden)), np.zeros(self.hidden), rng.normal(0, self.hidden**-0.5, self.hidden), 0.0]
        best, least = w, np.inf
        for _ in range(self.epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), self.batch):
                i = order[lo : lo + self.batch]
                h = self._sigmoid(x[i] @ w[0] + w[1])
                g = (self._sigmoid(h @ w[2] + w[3]) - y[i]) / len(i)
                gh = np.outer(g, w[2]) * h * (1 - h)
                w = [w[0] - self.rate * x[i].T @ gh, w[1] - self.rate * gh.sum(0), w[2] - self.rate * h.T @ g, w[3] - self.rate * g.sum()]
            self.weights = w
            p = np.clip(self.score(x_val), 1e-9, 1 - 1e-9)
            loss = -np.mean(y_val * np.log(p) + (1 - y_val) * np.log(1 - p))
            if loss < least:
                best, least = w, loss
        self.weights = best
        return self


def scored(candidates: DataFrame, features: str, model: TwoLayers, name: str = "score") -> DataFrame:
    """Candidates with the network's score of their feature array, in Arrow batches."""

    @F.pandas_udf("double")
    def run(x: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in x:
            yield pd.Series(model.score(np.stack(part.to_numpy())) if len(part) else [], dtype="float64")

    return candidates.withColumn(name, run(F.col(features)))


def best_candidate(rows: DataFrame, mention: list[str], score: str = "score") -> DataFrame:
    """One row a mention: the candidate of highest score, the smaller entity on ties."""
    return rows.groupBy(*mention).agg(F.min_by("entity_id", F.struct((-F.col(score)).alias("s"), (-F.col("prior")).alias("p"), "entity_id")).alias("entity_id"), F.max(score).alias(score))
