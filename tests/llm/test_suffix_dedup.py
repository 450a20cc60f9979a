import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import queries as q
from loomspan.llm import suffix_dedup as sd

SF = "/root/testdata/sf0.001"


def brute(rows, length=100):
    """rows: (doc_id, text) in order -> (doc_id, bytes, removed, runs, hash of what is left)."""
    seen, out = set(), []
    for doc, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = 1
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        runs = int((np.diff(np.r_[0, gone]) == 1).sum())
        out.append((doc, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_query(spark):
    docs = sorted((r.doc_id, r.text) for r in q._read(spark, SF, "documents").collect())
    got = sorted(tuple(r) for r in q.op1_suffix_dedup(spark, SF).collect())
    want = brute(docs)
    assert got == want and sum(r[2] for r in want) > 1000


def texts(rng):
    alphabet = "abcdefgh é😀"
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    base = [word(400) for _ in range(6)]
    out = [None, "", "a" * 99, "a" * 100, "a" * 5000, "ab" * 300, word(100), "x" * 1000 + "y" + "x" * 1000]
    for i in range(120):
        b = rng.choice(base)
        s = rng.randrange(200)
        piece = b[s : s + rng.choice([60, 99, 100, 101, 130, 200])]
        kind = i % 4
        if kind == 0:
            out.append(word(rng.randrange(150)) + piece + word(rng.randrange(150)))
        elif kind == 1:
            k = rng.randrange(len(b))
            out.append(b[:k] + word(1) + b[k:])
        elif kind == 2:
            out.append(piece * 3)
        else:
            out.append(b)
    return out


SMALL = sd.Limits(chunk=3000, piece=300)
TINY = sd.Limits(chunk=3000, piece=300, rows=7, heavy=5, held=50)


@pytest.mark.parametrize("limits", [SMALL, TINY, sd.Limits(chunk=500, piece=300, rows=50, heavy=30, held=100, part=(200, 400))])
def test_edges(spark, limits):
    rng = random.Random(4)
    rows = [(3 * i, t) for i, t in enumerate(texts(rng))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).repartition(5)
    got = sorted(tuple(r) for r in q._suffix_digest(sd.remove_repeats(df, limits)).collect())
    assert got == brute(sorted(rows))


def test_anchor_spread_thinly(spark):
    """An anchor with a context or two in each of many chunks is found to be heavy, and its classes meet."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    core, sides = word(70), [word(60) for _ in range(5)]
    rows = [(i, word(50) + rng.choice(sides) + core + rng.choice(sides) + word(50)) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for limits in (sd.Limits(chunk=400, rows=9, heavy=20, held=30), sd.Limits(chunk=400, heavy=10**9)):
        got = sorted(tuple(r) for r in q._suffix_digest(sd.remove_repeats(df, limits)).collect())
        assert got == brute(rows)


def test_asked_lets_heavy_anchors_go():
    e = np.zeros(1000, sd.ENTRIES)
    e["h"] = np.r_[np.full(600, 7), np.arange(100, 400), np.arange(100, 200)]
    e["pos"] = np.arange(1000)
    got = np.concatenate(list(sd._asked(iter(np.array_split(np.random.default_rng(0).permutation(e), 40)), sd.Limits(heavy=50, held=100))))
    assert sorted(got["pos"][got["h"] == 7]) == list(range(600)) and got["hot"][got["h"] == 7].all()
    assert sorted(set(got["h"][got["h"] != 7])) == list(range(100, 200)) and not got["hot"][got["h"] != 7].any()


def test_equal_hashes_do_not_remove(spark):
    """Windows that only share a hash stay: classes come from bytes."""
    w = np.zeros(4, sd.WINDOWS)
    w["doc"] = np.arange(4)
    w["bytes"] = np.arange(4)[:, None] // 2
    assert sd._late_windows(w, 10).tolist() == [False, True, False, True]
    assert sd._late_windows(np.repeat(w, 5), 3).sum() == 18


def test_repeated_rows_and_nulls(spark):
    rng = random.Random(1)
    t = "".join(rng.choice("abcdef ") for _ in range(300))
    df = spark.createDataFrame([(1, t), (1, t), (1, t), (None, t), (2, "short"), (2, "short"), (None, None)], "doc_id long, text string")
    got = sd.remove_repeats(df).collect()
    size = sorted((str(r.doc_id), r.n_bytes, len(r.kept)) for r in got)
    assert size == [("1", 300, 0), ("1", 300, 0), ("1", 300, 300), ("2", 5, 5), ("2", 5, 5), ("None", 0, 0), ("None", 300, 0)]
    assert sd.remove_repeats(df.limit(0)).count() == 0


def test_null_ids_with_different_texts(spark):
    """Rows without an id are parted by their text, and come after all others."""
    rng = random.Random(2)
    t = ["".join(rng.choice("abcdef ") for _ in range(300)) for _ in range(40)]
    df = spark.createDataFrame([(None, x) for x in t] + [(None, t[0]), (5, t[1])], "doc_id long, text string")
    kept = {(r.doc_id, bytes(r.kept).decode()) for r in sd.remove_repeats(df).collect()}
    assert kept == {(None, x) for x in t if x != t[1]} | {(None, ""), (5, t[1])}


def test_interval_expansion():
    rng = np.random.default_rng(0)
    for trial in range(30):
        n = int(rng.integers(1, 40))
        group = np.sort(rng.integers(0, 4, n))
        ctx = np.tile(rng.integers(97, 100, (4, sd.WIDTH)), (1, 1)).astype(np.uint8)[group]
        for i in range(n):
            for _ in range(int(rng.integers(0, 4))):
                ctx[i, rng.integers(0, sd.WIDTH)] = rng.integers(97, 100)
        left, right = rng.integers(0, sd.SIDE + 1, n), rng.integers(40, 101, n)
        rows, new = sd.repeated_windows(group, ctx, left, right)
        for o in range(len(rows)):
            label = {}
            kinds = np.r_[new[o]].cumsum()
            for r, k in zip(rows[o], kinds, strict=True):
                if o >= sd.SIDE - left[r] and o + 100 <= sd.SIDE + right[r]:
                    label.setdefault((group[r], ctx[r, o : o + 100].tobytes()), set()).add(int(k))
            assert all(len(v) == 1 for v in label.values())
            assert len({next(iter(v)) for v in label.values()}) == len(label), trial
