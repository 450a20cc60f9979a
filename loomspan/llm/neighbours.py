"""Nearest neighbours by a block matrix join on int8 tiles with error bounds.

Vectors are scaled to int8, and the length of what rounding loses is kept with each. Rows are dealt into
blocks; a block of queries meets a block of candidates as one tile, whose int8 product gives all
distances between rounded vectors at once. A true distance differs from that by at most the two lost
lengths, so a candidate whose lower bound exceeds the k-th smallest upper bound of its tile can't be among
the k nearest; the survivors are recomputed in double precision on the original vectors. A tile returns
k rows a query at most, and tiles are merged by heaps that hold k rows. The result is exact.

Only tiles that can matter are formed. A bounded sample of the vectors (at most PIVOTS, by hash of the id) serves as pivots; each
vector belongs to the cell of its nearest pivot, and a cell is cut into shells by distance to it. From its distances to
the pivots a query has a lower and an upper bound for all rows of a shell (triangle inequality); shells whose lower bound is
above the upper bound within which k rows are certain are left out for it, before any row is shuffled, and shells that no
query needs are not shuffled at all. Every vector is in a shell, so this too is exact; how much it saves depends on how far
the data form clusters. Only the table of shells (PIVOTS * SHELLS rows at most) is broadcast, and no group is gathered: a shell
is cut into tiles of a bounded number of vectors.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part;
only vectors of the same length are compared; rows that repeat an id and vector count once, and a query
meets no row with its own id; ties go to the smaller id; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize

#: Vectors in a tile, along candidates and along queries, on average.
TILE_ROWS, TILE_QUERIES = 16_384, 2_048
#: At most so many pivots, one for PIVOT_ROWS vectors, and shells in a cell.
PIVOTS, PIVOT_ROWS, SHELLS = 256, 512, 64


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>): the vectors that take part, repeated rows once."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    return fine.where(~bad).where(F.exists(v, lambda x: x != 0)).distinct()


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    arr = column.combine_chunks()
    return arr.flatten().to_numpy(zero_copy_only=False).reshape(len(arr), -1)


def nearest_in_tile(q_ids, q, c_ids, c, k: int):
    """Rows (query, candidate, distance) of a tile: for each query its k nearest and no row of its own id."""
    scale = max(np.abs(q).max(), np.abs(c).max()) / 127
    qi, ci = np.rint(q / scale).astype(np.int8), np.rint(c / scale).astype(np.int8)
    lost = lambda x, i: np.sqrt(((x - i * scale) ** 2).sum(1))
    q_lost, c_lost = lost(q, qi), lost(c, ci)
    qf, cf = qi.astype(np.float32), ci.astype(np.float32)  # int8 products are whole numbers, exact in float32 up to 2**24
    if q.shape[1] * 127 * 127 >= 1 << 24:
        qf, cf = qf.astype(np.float64), cf.astype(np.float64)
    c_sq = (cf.astype(np.float64) ** 2).sum(1)
    out = []
    for lo in range(0, len(q), 256):
        part = slice(lo, lo + 256)
        sq = (qf[part].astype(np.float64) ** 2).sum(1)[:, None] + c_sq - 2.0 * (qf[part] @ cf.T)
        near = np.sqrt(np.maximum(sq, 0)) * scale
        near[q_ids[part, None] == c_ids] = np.inf
        slack = (q_lost[part, None] + c_lost) * (1 + 1e-9) + 1e-12 * scale + near.clip(max=1e300) * 1e-12
        upper = near + slack
        kth = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] > k else np.full(len(upper), np.inf)
        rows, cols = np.nonzero((near - slack <= kth[:, None]) & np.isfinite(near))
        exact = np.zeros(len(rows))
        for a, b in zip(q.T, c.T, strict=True):  # component by component, so that equal pairs give equal sums in any tile
            exact += (a[lo + rows] - b[cols]) ** 2
        exact = np.sqrt(exact)
        order = np.lexsort((c_ids[cols], exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        top = rank < k
        out.append((q_ids[lo + rows[top]], c_ids[cols[top]], exact[top]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and matrix of the vectors of each length in column v."""
    lengths = batch.column("d").to_numpy(zero_copy_only=False)
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        part = batch.column("v").take(pa.array(rows))
        yield d, rows, part.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), d)


def _distances(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of rows to pivots, and a bound for their rounding errors."""
    a, b = (x**2).sum(1), (p**2).sum(1)
    return np.sqrt(np.maximum(a[:, None] + b - 2 * (x @ p.T), 0)), 1e-6 * (np.sqrt(a) + np.sqrt(b.max()))


def _cells(rows: DataFrame, pivots) -> DataFrame:
    """Add cell (number of the nearest pivot of the same length, or minus the length if there is none) and r, the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, r = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for d, own, x in _by_length(batch):
                cell[own] = -d
                if d in pivots.value:
                    first, p = pivots.value[d]
                    far, _ = _distances(x, p)
                    nearest = far.argmin(1)
                    cell[own], r[own] = first + nearest, far[np.arange(len(own)), nearest]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(r)], names=[*batch.schema.names, "cell", "r"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, d int, cell long, r double")


def needed(dist: np.ndarray, slack: np.ndarray, cell: np.ndarray, least: np.ndarray, most: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Marks (queries x shells) of the shells that may hold one of a query's k nearest.

    dist: queries x pivots; of each shell: the pivot ``cell``, least and greatest distance to it, number of rows.
    """
    at = dist[:, cell]
    lower = np.maximum(at - most, least - at) - slack[:, None]
    upper = at + most + slack[:, None]
    order = np.argsort(upper, axis=1)
    reach = np.take_along_axis(upper, order, 1)
    certain = n[order].cumsum(1) >= k
    kth = np.where(certain.any(1), reach[np.arange(len(at)), certain.argmax(1)], np.inf)
    return lower <= kth[:, None]


def _shells_of_queries(queries: DataFrame, pivots, shells: list, k: int) -> DataFrame:
    """vec_id, v, d, shells (array): for each query the shells that may hold one of its k nearest."""
    table = {}
    for d, (first, p) in pivots.value.items():
        own = [s for s in shells if first <= s.cell < first + len(p)]
        table[d] = [np.array([getattr(s, f) for s in own]) for f in ("shell", "cell", "least", "most", "n")]
    alone = {-s.cell: [s.shell] for s in shells if s.cell < 0}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[]] * batch.num_rows
            for d, own, x in _by_length(batch):
                if d not in pivots.value:
                    for i in own.tolist():
                        out[i] = alone[d]
                    continue
                first, p = pivots.value[d]
                shell, cell, least, most, n = table[d]
                for lo in range(0, len(own), 64):
                    dist, slack = _distances(x[lo : lo + 64], p)
                    for i, marks in zip(own[lo : lo + 64].tolist(), needed(dist, slack, cell - first, least, most, n, k), strict=True):
                        out[i] = shell[marks].tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], names=[*batch.schema.names, "shells"])

    return queries.mapInArrow(run, "vec_id long, v array<double>, d int, shells array<long>")


def _shelled(cells: DataFrame, tile_rows: int) -> DataFrame:
    """Add shell: cells are cut by r into as many shells of equal width as they hold tiles, SHELLS at most."""
    cuts = cells.groupBy(F.col("cell").alias("_c")).agg(F.count("*").alias("_n"), F.min("r").alias("_lo"), F.max("r").alias("_hi"))
    cuts = materialize(cuts, "cells")  # a row a pivot
    parts = F.least(F.ceil(F.col("_n") / tile_rows), F.lit(SHELLS)).cast("long")
    at = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("r") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * parts)).otherwise(0)
    out = cells.join(F.broadcast(cuts), F.col("cell") == F.col("_c"))
    return out.withColumn("shell", F.col("cell") * SHELLS + F.least(at, parts - 1)).drop("_c", "_n", "_lo", "_hi")


def tiles(vectors: DataFrame, is_query: Column, k: int, tile_rows: int, tile_queries: int, pivot_rows: int = PIVOT_ROWS, **columns) -> tuple[DataFrame, DataFrame]:
    """Queries and candidates with their tile (shell, i, j): a query meets every row that may be among its k nearest in one tile."""
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, **columns).withColumn("d", F.size("v")), "vectors")
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(min(PIVOTS, max(1, total // pivot_rows))).collect()  # PIVOTS at most
    by: dict = {}
    for r in sample:
        by.setdefault(r.d, []).append(r.v)
    first, pivots = 0, {}
    for d, v in sorted(by.items()):
        pivots[d] = (first, np.unique(np.array(v, float), axis=0))
        first += len(v)
    shared = spark.sparkContext.broadcast(pivots)
    cells = _shelled(materialize(_cells(rows, shared), "cells"), tile_rows)
    shells = cells.groupBy("cell", "shell").agg(F.count("*").alias("n"), F.min("r").alias("least"), F.max("r").alias("most")).collect()  # PIVOTS * SHELLS at most
    own = rows.groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0  # rows that a query must not meet
    queries = materialize(_shells_of_queries(rows.where(is_query), shared, shells, k + own), "queries")
    asked = queries.select("*", F.explode("shells").alias("shell")).drop("shells")
    wanted = {r.shell: r.n for r in asked.groupBy("shell").agg(F.count("*").alias("n")).collect()}
    plan = [(s.shell, -(-s.n // tile_rows), -(-wanted[s.shell] // tile_queries)) for s in shells if s.shell in wanted]
    plan = F.broadcast(spark.createDataFrame(plan, "_s long, down int, across int"))
    deal = lambda parts, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    q = asked.join(plan, F.col("shell") == F.col("_s")).select("vec_id", "v", "shell", deal("across", 2).alias("j"), "down").select("vec_id", "v", "shell", "j", every("down").alias("i"))
    c = cells.join(plan, F.col("shell") == F.col("_s")).select("vec_id", "v", "shell", deal("down", 1).alias("i"), "across").select("vec_id", "v", "shell", "i", every("across").alias("j"))
    return q, c


def search(vectors: DataFrame, is_query: Column, k: int = 10, tile_rows: int = TILE_ROWS, tile_queries: int = TILE_QUERIES, **more) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every query (``is_query`` over vec_id) among all other rows."""
    q, c = tiles(vectors, is_query, k, tile_rows, tile_queries, **more)

    def tile(q: pa.Table, c: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not q.num_rows or not c.num_rows:
            return schema.empty_table()
        ids = [t.column("vec_id").to_numpy() for t in (q, c)]
        return pa.table(dict(zip(schema.names, nearest_in_tile(ids[0], _matrix(q.column("v")), ids[1], _matrix(c.column("v")), k), strict=True)), schema)

    found = q.groupBy("shell", "i", "j").cogroup(c.groupBy("shell", "i", "j")).applyInArrow(tile, "query_id long, vec_id long, score double")

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by query, so one heap is held at a time."""

        def done(q, heap):
            best = sorted((-a, -b) for a, b in heap)
            return [(q, r + 1, v, s) for r, (s, v) in enumerate(best)]

        now, heap = None, []
        for frame in frames:
            out = []
            for q, v, s in zip(frame.query_id, frame.vec_id, frame.score, strict=True):
                if q != now:
                    out += done(now, heap)
                    now, heap = q, []
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (-s, -v))
            yield pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
        yield pd.DataFrame(done(now, heap), columns=["query_id", "rank", "vec_id", "score"])

    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts, "query_id").sortWithinPartitions("query_id").mapInPandas(merge, "query_id long, rank int, vec_id long, score double")
