"""The pipeline against brute force: each stage is judged on its own input."""

import collections

import brute
import corpus_pipeline as cp
from loomspan.llm._common import materialize
from test_groups import brute_fp, brute_groups

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    from tokenizers import Tokenizer

    from loomspan.llm import packing

    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in cp.STAGES:
        docs.append(materialize(stage(spark, docs[-1], SF), "test"))
    assert all(d.columns == COLUMNS for d in docs[:-1])
    rows = [sorted(map(tuple, d.collect())) for d in docs]

    kept = {r[0] for r in rows[1]}
    assert set(rows[1]) <= set(rows[0])
    assert not any(brute.quality(r[1])[5] for r in rows[1])
    assert len(kept) > 0.75 * len(rows[0])

    fps = [brute_fp(r[1]) for r in rows[1]]
    assert rows[2] == [r for i, (r, root) in enumerate(zip(rows[1], brute_groups(fps), strict=True)) if i == root]

    assert [r[0] for r in rows[3]] == [r[0] for r in rows[2]]
    for before, after in zip(rows[2], rows[3], strict=True):
        assert before[2:4] == after[2:4] and after[4] == len(after[1])
        assert (before[1] != after[1]) >= bool(brute.pii_base(before[1]))
        assert not brute.pii_base(after[1])

    taken, size = collections.Counter(), {}
    for r in rows[4]:
        taken[r[0]] += 1
    whole = collections.Counter()
    for r in rows[3]:
        size[r[0]] = len(r[1].split())
        whole[r[3]] += size[r[0]]
    assert set(rows[4]) <= set(rows[3]) and max(taken.values()) <= 2
    by_source = collections.Counter()
    for r in rows[3]:
        by_source[r[3]] += taken[r[0]] * size[r[0]]
    for source, want in brute.mix_targets(dict(whole)).items():
        assert abs(by_source[source] - want) <= max(size.values())

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    texts = {r[0]: r[1] for r in rows[3]}
    ids = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    total = sum(ids[i] * n for i, n in taken.items())
    packed = docs[-1].collect()
    assert sum(r.length for r in packed) == total
    once = {}
    for r in packed:
        once.setdefault((r.doc_id, r.piece), r)
    assert collections.Counter((r.doc_id, r.piece) for r in packed) == {k: taken[k[0]] for k in once}
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
    assert check_places(packed) <= 1.1 * -(-total // 4096) + 1


def check_places(packed):
    places = collections.defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    return len(places)


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, SF), "test")
        assert docs.count() == 0
