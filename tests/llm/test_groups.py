"""SimHash groups and packing against brute force and edge cases."""

import collections
import random
import struct
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.llm import packing, simhash
from loomspan.llm import queries as q
from loomspan.llm.components import components

SF = "/root/testdata/sf0.001"


def brute_fp(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, distance=3):
    """index -> smallest index reachable."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", "A b", "One two  THREE\x0bfour", "Ärger É x y", "a " * 200_000, "w\x1fx   y z q"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fp(text)


def test_simhash_query(spark):
    docs = sorted((r.doc_id, r.text) for r in q._read(spark, SF, "documents").collect())
    fps = [brute_fp(t) for _, t in docs]
    want = brute_groups(fps)
    got = sorted(tuple(r) for r in q.op5_simhash(spark, SF).collect())
    assert got == [(i, f"{fp:016x}", docs[w][0]) for (i, _), fp, w in zip(docs, fps, want, strict=True)]
    assert len({r[2] for r in got}) < len(got)


@pytest.fixture
def small_limits(monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 8)


def cluster(rng, n, flips):
    out = {rng.getrandbits(64)}
    while len(out) < n:
        x = rng.choice(sorted(out))
        for _ in range(rng.randrange(1, flips + 1)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def links_of(spark, fps):
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    return components(simhash.links(df))


@pytest.mark.parametrize("flips", [1, 3, 5])
def test_links_keep_groups_whole(spark, small_limits, flips):
    fps = cluster(random.Random(flips), 150, flips) + [0]
    got = collections.defaultdict(set)
    for r in links_of(spark, fps).collect():
        got[r.root].update({r.node, r.root})
    want = collections.defaultdict(set)
    for i, w in enumerate(brute_groups(fps)):
        want[w].add(np.uint64(fps[i]).astype(np.int64).item())
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_forest_of_large_group(small_limits):
    rng = random.Random(1)
    fps = np.array(cluster(rng, 60, 3), np.uint64)
    root = simhash.forest(np.zeros(60, int), fps)
    want = brute_groups([int(x) for x in fps])
    assert len(set(zip(root.tolist(), want, strict=True))) == len(set(want)) == len(set(root.tolist()))


def test_near_duplicates_edges(spark):
    data = [(3, None), (5, ""), (None, "x y z"), (2, "x y z"), (2, "x y z"), (9, "other words here now"), (None, "alone indeed it is")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = simhash.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("2", "2"), ("2", "2"), ("3", "3"), ("5", "3"), ("9", "9"), ("None", "2"), ("None", "None")]
    assert sum(r.keep for r in got) == 4
    assert simhash.near_duplicates(df.limit(0)).count() == 0 == simhash.one_of_each(df.limit(0)).count()
    one = simhash.one_of_each(df)
    assert one.columns == df.columns and sorted((str(r.doc_id), r.text) for r in one.collect()) == [("2", "x y z"), ("3", None), ("9", "other words here now"), ("None", "alone indeed it is")]


@pytest.mark.parametrize("hot,broadcast", [(3, 0), (10**6, 10**6)])
def test_hot_fingerprints(spark, monkeypatch, hot, broadcast):
    """Fingerprints of many rows are looked up, others joined: the same groups either way."""
    monkeypatch.setattr(simhash, "HOT_ROWS", hot)
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", broadcast)
    data = [(i, "same words in all of these" if i % 3 else f"own words {i} and {i * i} more") for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = simhash.near_duplicates(df).collect()
    assert {r.doc_id for r in got if r.component_id == 1} == {i for i in range(60) if i % 3} and sum(r.keep for r in got) == 21
    assert {r.doc_id for r in simhash.one_of_each(df).collect()} == {1, *range(0, 60, 3)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (300, 300), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 0, 201: 200}


def check_packing(rows, texts, capacity, tokenizer):
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts}
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        for r in own:
            part = ids[i][r.start : r.start + r.length]
            assert r.start == r.piece * capacity and r.length == len(part)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        assert sum(r.length for r in own) == len(ids[i])
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing_query(spark):
    from tokenizers import Tokenizer

    texts = [(r.doc_id, r.text) for r in q._read(spark, SF, "documents").collect()]
    rows = q.op2_best_fit_packing(spark, SF).collect()
    used = check_packing(rows, texts, 4096, Tokenizer.from_file(packing.default_tokenizer()))
    assert used <= 1.03 * -(-sum(r.length for r in rows) // 4096) + 1


def test_packing_edges(spark):
    from tokenizers import Tokenizer

    odd = [None, "", " \n ", "I'm HERE, it's 2024! don't", "ΣΑΣ ΟΔΟΣ. İstanbul ﬁ é ̈x a b c　d", "x" * 9000, "<|endoftext|> a<|startoftext|>b", "日本語 text 😀😀 ' '' s 's", "word " * 5000, "\x1f\x85  y"]
    texts = list(enumerate(odd))
    df = spark.createDataFrame([(*t, "clash") for t in texts], "doc_id long, text string, task string")
    check_packing(packing.pack(df).collect(), texts, 4096, Tokenizer.from_file(packing.default_tokenizer()))
    tokens = packing.tokenize(df, capacity=64)
    placed = packing.place(tokens.drop("ids"), 64)
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(tokens, placed).collect()}
    part = {(r.uid, r.piece): bytes(r.ids) for r in tokens.collect()}
    for r in placed.collect():
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == part[r.uid, r.piece]
    assert packing.pack(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_plan(counts):
    table, used = packing.plan_bins(counts, 30)
    room, ranks = collections.defaultdict(list), collections.Counter()
    for length, first, n, start, offset in table.tolist():
        assert first == ranks[length]
        ranks[length] += n
        for i in range(n):
            room[start + i].append((offset, length))
    assert ranks == collections.Counter(counts) and set(room) == set(range(used))
    for own in room.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 30
    assert used <= -(-3 * sum(k * v for k, v in counts.items()) // 60) + 1 + sum(v for k, v in counts.items() if k > 10)
