"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, connected groups.

Fingerprints: majority of the bits of XXH64 (seed 42) over 3-word shingles. 64 bits are cut into six
blocks; fingerprints that differ in at most three bits share three whole blocks, so distinct
fingerprints are keyed by each of the 20 choices of three blocks and compared within a key. A key with over
HOT fingerprints is split again in the same way by the bits that are left, which bounds a group by the
number of values these bits can take; a large group looks up its members' neighbours instead of
comparing pairs. Each group emits a spanning forest of its links, never all pairs; the groups join up by
connected components.

Copies are one fingerprint throughout; they are only met again in the last join, which looks up fingerprints of very many
rows in a broadcast table of a bounded number of them, and shuffles ids alone for the others.

Defined results: null and blank texts have fingerprint zero and link like any other; texts of one or two
words are one shingle; repeated rows share their group, of which one row is kept; a null doc_id counts as
larger than all; an empty table gives an empty result; other columns ride along in ``row`` (only in ``one_of_each``).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import BROADCAST_ROWS, join_small, materialize, small_batches, tidy
from .components import components

SEED, SHINGLE, DISTANCE = 42, 3, 3
BLOCKS = (11, 11, 11, 11, 10, 10)
SUB_BLOCKS = (6, 6, 6, 5, 5, 5)  # of the up to 33 bits outside a key
HOT = 2048
HOT_ROWS = 100_000
_STEP = 1 << 16


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters, ASCII white space
    if not words:
        return 0
    xx = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return xx(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(itertools.islice(words, k, None) for k in range(SHINGLE)), strict=False))
    n, counts = len(words) - SHINGLE + 1, np.zeros(64, np.int64)
    while part := [xx(s, SEED) for s in itertools.islice(shingles, _STEP)]:
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(t.as_py()) for t in batch.column("_text")], np.uint64).view(np.int64)  # one text at a time in memory
        columns = [c for c in batch.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(fps)], names=[*columns, "fp"])


def numbered(docs: DataFrame, carry: bool = False) -> DataFrame:
    """uid, doc_id, text[, row]; with ``row`` written out, so that the row numbers ``uid`` hold for a second reading."""
    uid = F.monotonically_increasing_id().alias("uid")
    if not carry:
        return docs.select(uid, "doc_id", F.col("text").alias("_text"))
    rows = materialize(docs.select(uid, F.struct("*").alias("row")), "rows")
    return rows.select("uid", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("_text"), "row")


def fingerprints(rows: DataFrame) -> DataFrame:
    """``numbered`` rows -> uid, doc_id, fp (signed 64 bits); written out. Texts alone pass through Python, no other columns."""
    frame = rows.select("uid", "doc_id", "_text")
    schema = T.StructType([f for f in frame.schema.fields if f.name != "_text"] + [T.StructField("fp", T.LongType())])
    with small_batches(rows.sparkSession):
        return materialize(frame.mapInArrow(tidy(_fingerprints), schema), "simhash")


def _parts(x: Column, widths: tuple[int, ...]) -> list[Column]:
    out, shift = [], 0
    for w in widths:
        out.append(F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << w) - 1).cast("long")))
        shift += w
    return out


def _packed(parts: list[Column], widths: list[int]) -> Column:
    out = F.lit(0).cast("long")
    for p, w in zip(parts, widths, strict=True):
        out = F.shiftleft(out, w).bitwiseOR(p)
    return out


def _choices(x: Column, widths: tuple[int, ...]) -> Column:
    """Array of (key, rest) for each choice of half of the blocks; key holds the choice's number too."""
    parts, out = _parts(x, widths), []
    for n, chosen in enumerate(itertools.combinations(range(len(widths)), len(widths) - DISTANCE)):
        other = [i for i in range(len(widths)) if i not in chosen]
        key = F.shiftleft(F.lit(n).cast("long"), 40).bitwiseOR(_packed([parts[i] for i in chosen], [widths[i] for i in chosen]))
        out.append(F.struct(key.alias("key"), _packed([parts[i] for i in other], [widths[i] for i in other]).alias("rest")))
    return F.array(*out)


def _join_up(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the pairs in a forest of flat trees."""
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            return
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def forest(group: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """For rows sorted by group: the index of the root of each row under links within its group."""
    n = len(fps)
    root = np.arange(n)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[first, n])
    large = sizes > 2 * HOT
    for lo, m in zip(first[large], sizes[large], strict=True):
        own = fps[lo : lo + m]
        order = np.argsort(own)
        ranked = own[order]
        varying = int(np.bitwise_or.reduce(own ^ own[0]))
        bits = [1 << k for k in range(64) if varying >> k & 1]
        for r in range(DISTANCE + 1):
            for chosen in itertools.combinations(bits, r):
                want = ranked ^ np.uint64(sum(chosen))
                at = np.minimum(np.searchsorted(ranked, want), m - 1)
                hit = np.flatnonzero(ranked[at] == want)
                a, b = order[hit] + lo, order[at[hit]] + lo
                _join_up(root, a[a != b], b[a != b])
    ends = np.repeat(np.where(large, first, first + sizes), sizes)
    at, d = np.arange(n), 1
    while len(at := at[at + d < ends[at]]):
        near = at[np.bitwise_count(fps[at] ^ fps[at + d]) <= DISTANCE]
        _join_up(root, near, near + d)
        d += 1
    return root


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, sub); a group may span batches, and is complete before it is searched."""

    def edges(key, sub, fp):
        group = np.r_[False, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])].cumsum() if len(key) else key
        root = forest(group, fp.view(np.uint64))
        b = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(fp[root[b]]), pa.array(fp[b])], names=["a", "b"])

    held = [np.empty(0, np.int64)] * 3
    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "sub", "fp")]
        if not len(new[0]):
            continue
        held = [np.concatenate(x) for x in zip(held, new, strict=True)]
        if len(held[0]) < 50_000:
            continue
        last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield edges(*[x[:cut] for x in held])
            held = [x[cut:] for x in held]
    yield edges(*held)


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints ``fp`` -> edges (a, b): enough links at DISTANCE bits or fewer to keep every group whole."""
    keyed = fps.select("fp", F.explode(_choices(F.col("fp"), BLOCKS)).alias("k")).select("fp", "k.key", "k.rest")
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key", F.lit(True).alias("hot"))
    hot = materialize(hot, "hot")
    marked = join_small(keyed, hot, ["key"], hot.count())
    cold = marked.where("hot is null").select("key", F.lit(0).cast("long").alias("sub"), "fp")
    again = marked.where("hot is not null").select("key", "fp", F.explode(_choices(F.col("rest"), SUB_BLOCKS)).alias("k"))
    again = again.select("key", (F.col("k.key") + 1).alias("sub"), "fp")
    spark = fps.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cold.unionByName(again).repartition(parts, "key", "sub").sortWithinPartitions("key", "sub", "fp")
    return dealt.mapInArrow(tidy(_forests), "a long, b long").distinct()


def _grouped(table: DataFrame) -> DataFrame:
    """uid, doc_id, fp, head (smallest doc_id and uid of the group) of the rows of a table of ``fingerprints``."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first")
    fps = materialize(table.groupBy("fp").agg(first, F.count("*").alias("n")), "fps")
    groups = components(links(fps.select("fp")))
    nodes = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    member = fps.join(nodes, F.col("fp") == F.col("node")).select("fp", "root", "first")
    heads = member.groupBy("root").agg(F.min("first").alias("head")).withColumnRenamed("root", "r")
    moved = member.join(heads, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "head")
    whole = materialize(fps.join(moved, F.col("fp") == F.col("f"), "left").select(F.col("fp").alias("f"), F.coalesce("head", "first").alias("head"), "n"), "groups")
    # fingerprints of very many rows are looked up, not shuffled; as each has a 10,000th of the rows, there are 10,000 at most
    hot = whole.where(F.col("n") >= F.lit(max(HOT_ROWS, (whole.agg(F.sum("n")).first()[0] or 0) // 10_000))).select("f", "head")
    narrow = table.select("uid", "doc_id", "fp")
    fast = narrow.join(F.broadcast(hot), F.col("fp") == F.col("f"))
    rest = narrow.join(F.broadcast(hot.select("f")), F.col("fp") == F.col("f"), "left_anti").join(whole.drop("n"), F.col("fp") == F.col("f"))
    return fast.unionByName(rest).drop("f")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id of the group), keep (true for one row of each group)."""
    out = _grouped(fingerprints(numbered(docs)))
    return out.select("doc_id", "fp", F.col("head.doc_id").alias("component_id"), (F.col("uid") == F.col("head.uid")).alias("keep"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, one of each group. Whole rows stay where they are, but for very many rows to drop."""
    rows = numbered(docs, carry=True)
    drop = materialize(_grouped(fingerprints(rows)).where("uid != head.uid").select(F.col("uid").alias("u")), "copies")
    drop = F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else drop
    return rows.join(drop, F.col("uid") == F.col("u"), "left_anti").select("row.*")
