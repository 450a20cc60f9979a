"""Removal of repeated byte strings by interval expansion on a Burrows-Wheeler transform.

A byte goes if it lies in a string of MIN_LENGTH bytes that also starts earlier (smaller doc_id, or same
document and earlier start). Three steps, none of which holds more than a bounded share of the corpus:

1. Anchors. Each MIN_LENGTH window picks the GRAM-byte strings of least hash in it, so equal windows pick the
   same ones, and two windows can only be equal if they meet under an anchor. An anchor's context is all
   windows over it. Within a chunk of text, contexts that are equal byte by byte are folded into the earliest,
   which is the one row that the transform gets for them; the others are repeats. Anchors with one context
   in the whole corpus are done.
2. Interval expansion (``repeated_windows``). The contexts under an anchor, aligned at it, form
   a collection; its Burrows-Wheeler transform is built column by column, and breadth-first backward
   extension sets the common-prefix values 0, 1, 2, ... in increasing order until MIN_LENGTH. Boundaries
   never reached part the classes of equal windows; all but the earliest of a class are repeats. Contexts of an anchor
   with very many of them are dealt over the tasks, and the first window of each class then meets those of the other
   tasks in a second transform, over whole windows.
3. Removal. Covered ranges meet their document and are cut out.

Hashes only bring candidates together: that two strings are equal is always told from their bytes. Rows travel as packed
blobs, and all that is read twice is written to the shared folder. Work is dealt by ``part``, a number of bounded text;
a task takes several parts one after the other where there are more parts than TASKS.

Defined results: a null text is empty; a null doc_id counts as larger than all; rows that repeat a doc_id are
ordered by a 64-bit hash of their text, and of rows that repeat both, one counts as first; documents under MIN_LENGTH
bytes stay whole; an empty table gives an empty result; other columns are ignored. Texts are taken as UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, tidy

MIN_LENGTH, GRAM = 100, 32
SIDE = MIN_LENGTH - GRAM  # of a context, before the anchor; MIN_LENGTH behind its start
WIDTH = SIDE + MIN_LENGTH
NULL_ID = np.iinfo(np.int64).max
COVER, ENTRY, TEXT, WINDOW = 0, 1, 2, 3
SCHEMA = "part int, kind int, data binary"
TASKS = 20_000


@dataclass(frozen=True)
class Limits:
    """What a task holds at once: knobs for memory, without effect on results."""

    chunk: int = 4 << 20  # bytes of text treated at once
    piece: int = 1 << 16  # windows hashed at once; temporary arrays stay in the cache
    rows: int = 12_000  # contexts in one transform
    heavy: int = 200_000  # contexts from which an anchor is dealt over all tasks
    held: int = 4_000_000  # entries of anchors held at once
    part: tuple[int, int] = (16 << 20, 64 << 20)  # bytes of text a part stands for, in small and very large corpora


_A, _B, _C = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0x9FB21C651E98DF25, 0x9E3779B97F4A7C15))
_S = [np.uint64(x) for x in (32, 29, 32)]
_PLACE = [("doc", "i8"), ("th", "u8"), ("pos", "i4"), ("left", "u1"), ("right", "u1")]
ENTRIES = np.dtype([("h", "u8"), *_PLACE, ("hot", "u1")])
CONTEXT = np.dtype([("h", "u8"), *_PLACE, ("hot", "u1"), ("bytes", "u1", (WIDTH,))])
COVERS = np.dtype([("doc", "i8"), ("th", "u8"), ("start", "i4"), ("end", "i4")])
WINDOWS = np.dtype([("w", "u8"), ("doc", "i8"), ("th", "u8"), ("start", "i4"), ("bytes", "u1", (MIN_LENGTH,))])
TEXTS = np.dtype([("doc", "i8"), ("th", "u8"), ("size", "i4")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _S[0])
    x *= _A
    x ^= x >> _S[1]
    x *= _B
    x ^= x >> _S[2]
    return x


def _grams(b: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on."""
    h = (b.astype(np.uint64) + np.uint64(1)) * _A
    m, s = int(_C), 1
    while s < GRAM:
        h = h[:-s] * np.uint64(m) + h[s:]
        m, s = m * m & (1 << 64) - 1, 2 * s
    return h


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    s = 1
    while 2 * s <= w:
        x, s = f(x[:-s], x[s:]), 2 * s
    return f(x[: len(x) - (w - s)], x[w - s :]) if w > s else x


def anchors(b: np.ndarray, starts: np.ndarray, piece: int):
    """Anchors in concatenated documents (bounds ``starts``, end included): position, hash, context hash, left, right."""
    n, span = len(b), SIDE + 1
    sizes = np.diff(starts)
    out = []
    for w0 in range(0, max(0, n - MIN_LENGTH + 1), piece):
        w1 = min(w0 + piece, n - MIN_LENGTH + 1)
        e0, e1 = max(0, w0 - SIDE), min(n, w1 + 2 * SIDE + 2 * GRAM)
        g = _grams(b[e0:e1])
        h = _mix(g[w0 - e0 : w1 - e0 + SIDE])
        least = _slide(h, span, np.minimum)
        edge = np.zeros(w1 - w0 + 1, np.int64)  # windows that leave their document don't count
        np.add.at(edge, np.clip(np.maximum(starts[:-1], starts[1:] - MIN_LENGTH + 1) - w0, 0, w1 - w0), 1)
        np.add.at(edge, np.clip(starts[1:] - w0, 0, w1 - w0), -1)
        least[edge[:-1].cumsum() > 0] = 0
        pad = np.zeros(SIDE, np.uint64)
        p = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), span, np.maximum) == h)
        p = p[h[p] != 0]
        hp = h[p]
        p += w0
        d = np.searchsorted(starts, p, side="right") - 1
        left = np.minimum(p - starts[d], SIDE)
        right = np.minimum(starts[d] + sizes[d] - p, MIN_LENGTH)
        c = (left * 256 + right).astype(np.uint64)
        for o in (-SIDE, -SIDE + GRAM, -SIDE + 2 * GRAM, GRAM - 4, 2 * GRAM - 4, SIDE):
            c = _mix(c * _C + g[np.clip(p + o, p - left, p + right - GRAM) - e0])
        out.append((p, hp, c, left, right))
    if not out:
        return [np.empty(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64)]
    p, *rest = (np.concatenate(x) for x in zip(*out, strict=True))
    _, once = np.unique(p, return_index=True)  # pieces overlap by a window
    return [p[once], *[x[once] for x in rest]]


def _part_of(x: np.ndarray, parts: int) -> np.ndarray:
    return (_mix(x.astype(np.uint64) * _C) % np.uint64(parts)).astype(np.int64)


def _pack(a: np.ndarray, compress) -> bytes:
    """Fields one after the other, each compressed."""
    return compress(b"".join(np.ascontiguousarray(a[f]).tobytes() for f in a.dtype.names))


def _unpack(data: bytes, dtype: np.dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    out, at = np.empty(len(raw) // dtype.itemsize, dtype), 0
    for f in dtype.names:
        own = out[f]
        own[...] = np.frombuffer(raw, own.dtype, own.size, at).reshape(own.shape)
        at += own.nbytes
    return out


def _dealt(a: np.ndarray, part: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    compress = zstandard.ZstdCompressor(level=1).compress
    order = np.argsort(part, kind="stable")
    a, part = a[order], part[order]
    for own in np.split(np.arange(len(a)), np.flatnonzero(part[1:] != part[:-1]) + 1) if len(a) else ():
        yield int(part[own[0]]), kind, _pack(a[own], compress)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["part", "kind", "data"])


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """Documents (TEXTS, in order) with their bytes, ``chunk`` bytes at a time at least."""
    held, size = [], 0

    def done():
        held.sort(key=lambda x: x[:2])
        table = np.array([(d, t, len(b)) for d, t, b in held], TEXTS)
        return table, b"".join(x[2] for x in held)

    for batch in batches:
        for doc, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.append((NULL_ID if doc is None else doc, xxhash.xxh64_intdigest(b), b))
            size += len(b)
            if size >= chunk:
                yield done()
                held, size = [], 0
    if held:
        yield done()


def _merged(c: np.ndarray) -> np.ndarray:
    """Ranges of one document that touch become one."""
    c = c[np.lexsort((c["start"], c["th"], c["doc"]))]
    if not len(c):
        return c
    other = np.r_[True, (c["doc"][1:] != c["doc"][:-1]) | (c["th"][1:] != c["th"][:-1])]
    lift = other.cumsum().astype(np.int64) << 32
    upto = np.maximum.accumulate(lift + c["end"])
    first = np.r_[True, (lift + c["start"])[1:] > upto[:-1]]
    out = c[first].copy()
    out["end"] = (upto - lift)[np.r_[np.flatnonzero(first)[1:] - 1, len(c) - 1]]
    return out


def _covers(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), COVERS)
    out["doc"], out["th"], out["start"], out["end"] = a["doc"], a["th"], start, end
    return _merged(out)


def _folded(table: np.ndarray, data: bytes, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Entries of a chunk's anchors, contexts that equal an earlier one byte by byte left out, and what those cover."""
    b = np.frombuffer(data, np.uint8)
    starts = np.r_[0, table["size"].astype(np.int64).cumsum()]
    p, h, c, left, right = anchors(b, starts, limits.piece)
    d = np.searchsorted(starts, p, side="right") - 1
    e = np.zeros(len(p), ENTRIES)
    e["h"], e["pos"], e["left"], e["right"] = h, p - starts[d], left, right
    e["doc"], e["th"] = table["doc"][d], table["th"][d]
    # documents are in order, so the first of a run of equal keys under a stable sort is the earliest
    key = _mix(h * _C + c)
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.empty(0, bool)
    first = order[np.flatnonzero(new)[new.cumsum() - 1]] if len(k) else order
    late, of = order[~new], first[~new]
    equal = (left[late] == left[of]) & (right[late] == right[of])
    for s in range(0, len(late), 1 << 15):
        part = slice(s, s + (1 << 15))
        x, y = late[part], of[part]
        column = np.arange(-SIDE, MIN_LENGTH)
        inside = (column >= -left[x][:, None]) & (column < right[x][:, None])
        at = lambda i: b[np.clip(p[i][:, None] + column, 0, len(b) - 1)]  # noqa: E731, B023
        equal[part] &= ((at(x) == at(y)) | ~inside).all(axis=1)
    late = np.sort(late[equal])
    keep = np.ones(len(e), bool)
    keep[late] = False
    # of rows that repeat id and text, one counts as first: their places are the same, and nothing is covered
    repeated = np.zeros(len(table), bool)
    repeated[1:] = (table["doc"][1:] == table["doc"][:-1]) & (table["th"][1:] == table["th"][:-1])
    keep &= ~repeated[d]
    late = late[~repeated[d[late]]]
    return e[keep], _covers(e[late], e["pos"][late] - left[late], e["pos"][late] + right[late])


def repeated_windows(group: np.ndarray, ctx: np.ndarray, left: np.ndarray, right: np.ndarray, side: int = SIDE, stop: int = MIN_LENGTH):
    """Classes of equal windows of contexts aligned at their anchor (column ``side``).

    group: number of the anchor of each row, ascending. ctx: bytes, rows x columns; those outside the document
    (before side - left, from side + right on) don't matter. -> for each column a window can start at, stacked:
    rows in suffix order, and marks where a class begins. Windows that leave the document are alone or with such.

    The transform is that of the rows with symbols tagged by column, so a backward extension leads from the
    block of a column to that of the column before it.
    """
    n, width = ctx.shape
    column = np.arange(width)
    symbol = np.where((column >= side - left[:, None]) & (column < side + right[:, None]), ctx.astype(np.int16) + 1, np.int16(0))
    base = group.astype(np.int64) * 257
    order = np.arange(n)
    windows = width - stop + 1
    rows = np.empty((windows, n), np.int32)
    lf = np.empty((width, n), np.int32)  # where a suffix goes when the symbol before it is put in front
    prev = np.full((width, n), -1, np.int32)  # the suffix above it in the block with the same symbol before it
    lcp = np.full((width, n), 255, np.uint8)
    for o in range(width - 1, -1, -1):
        key = base[order] + symbol[order, o]
        perm = np.argsort(key, kind="stable")
        order, key = order[perm], key[perm]
        same = key[1:] == key[:-1]
        lcp[o, 0] = 0
        lcp[o, 1:][~same] = 0
        if o + 1 < width:
            lf[o + 1, perm] = np.arange(o * n, (o + 1) * n)
            prev[o + 1, perm[1:][same]] = perm[:-1][same] + (o + 1) * n
        if o < windows:
            rows[o] = order
    lf, prev, lcp = lf.ravel(), prev.ravel(), lcp.ravel()
    at = np.arange(width * n, dtype=np.int32)
    head = prev != at - 1  # where a run of equal symbols before the suffixes begins
    following = np.minimum.accumulate(np.where(head, at, width * n)[::-1])[::-1]
    following = np.r_[following[1:], [width * n]].astype(np.int32)
    begins = np.r_[True, group[1:] != group[:-1]]
    ends = np.repeat(np.r_[np.flatnonzero(begins)[1:], n], np.diff(np.r_[np.flatnonzero(begins), n])).astype(np.int32)
    mark = np.empty(width * n, np.int32)
    front = np.flatnonzero(lcp == 0).astype(np.int32)
    front = front[~begins[front % n]]
    for value in range(1, stop):
        b = front[front >= n]
        y, end, found = b, (b // n) * n + ends[b % n], []
        while len(y):
            x = prev[y]
            to = lf[y[(x >= 0) & (x < b)]]
            to = to[lcp[to] == 255]
            mark[to] = np.arange(len(to))
            to = to[mark[to] == np.arange(len(to))]
            lcp[to] = value
            found.append(to)
            y = following[y]
            on = y < end
            y, b, end = y[on], b[on], end[on]
            on = lcp[y] >= value  # a boundary of a lesser value has its own turn
            y, b, end = y[on], b[on], end[on]
        front = np.concatenate(found) if found else front[:0]
        if not len(front):
            break
    return rows, lcp.reshape(width, n)[:windows] != 255


def _expand(c: np.ndarray, emit_windows: bool) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of whole groups -> (covered ranges, first window of each class if asked for)."""
    c = c[np.argsort(c["h"], kind="stable")]
    group = np.r_[False, c["h"][1:] != c["h"][:-1]].cumsum()
    order = np.lexsort((c["pos"], c["th"], c["doc"]))
    rank = np.empty(len(c), np.int64)  # rows of one place, of documents that are there twice, share a rank
    rank[order] = np.r_[0, np.logical_or.reduce([c[f][order][1:] != c[f][order][:-1] for f in ("doc", "th", "pos")]).cumsum()]
    left, right = c["left"].astype(np.int64), c["right"].astype(np.int64)
    rows, new = repeated_windows(group, c["bytes"], left, right)
    flat, start = rows.ravel(), np.flatnonzero(new.ravel())
    least = np.repeat(np.minimum.reduceat(rank[flat], start), np.diff(np.r_[start, len(flat)]))
    column = np.repeat(np.arange(len(rows)), rows.shape[1])
    inside = (column >= SIDE - left[flat]) & (column + MIN_LENGTH <= SIDE + right[flat])
    late = inside & (rank[flat] != least)
    lo, hi = np.full(len(c), WIDTH), np.full(len(c), -1)
    np.minimum.at(lo, flat[late], column[late])
    np.maximum.at(hi, flat[late], column[late])
    hit = np.flatnonzero(hi >= 0)  # windows of a context overlap, so its covered bytes are one range
    cover = _covers(c[hit], c["pos"][hit] - SIDE + lo[hit], c["pos"][hit] - SIDE + hi[hit] + MIN_LENGTH)
    first = np.flatnonzero(inside & ~late) if emit_windows else np.empty(0, np.int64)
    w = np.empty(len(first), WINDOWS)
    if len(first):
        r, o = flat[first], column[first]
        w["bytes"] = np.lib.stride_tricks.sliding_window_view(c["bytes"], MIN_LENGTH, axis=1)[r, o]
        w["w"] = [xxhash.xxh64_intdigest(x.tobytes(), 7) for x in w["bytes"]]
        w["doc"], w["th"], w["start"] = c["doc"][r], c["th"][r], c["pos"][r] - SIDE + o
    return cover, w


def _late_windows(w: np.ndarray, rows: int) -> np.ndarray:
    """Marks of the windows (sorted by w, doc, th, start) that equal an earlier one, by transforms of ``rows`` at most."""
    late = np.zeros(len(w), bool)
    if not len(w):
        return late
    group = np.r_[0, (w["w"][1:] != w["w"][:-1]).cumsum()]

    def among(own: np.ndarray) -> None:
        place, new = repeated_windows(group[own], w["bytes"][own], np.zeros(len(own), int), np.full(len(own), MIN_LENGTH), side=0)
        kind = new[0].cumsum() - 1
        least = np.minimum.reduceat(place[0], np.flatnonzero(new[0]))  # own is sorted, so the least is the earliest
        late[own[place[0][place[0] != least[kind]]]] = True

    begin = 0
    firsts = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(w)]
    while begin < len(firsts) - 1:
        end = max(begin + 1, int(np.searchsorted(firsts, firsts[begin] + rows, side="right")) - 1)
        own = np.arange(firsts[begin], firsts[end])
        held = own[:0]
        for s in range(0, len(own), rows):  # one group may be larger: its earliest go on to the next piece
            now = np.concatenate([held, own[s : s + rows]])
            among(now)
            held = now[~late[now]]
        begin = end
    return late


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, bytes]]]]:
    """Rows that come sorted by part -> each part with its (kind, data)."""
    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
    for part, own in groupby(rows, key=lambda r: r[0]):
        yield part, ((k, d) for _, k, d in own)


def _shuffle(df: DataFrame, parts: int) -> DataFrame:
    tasks = min(parts, TASKS)
    return df.repartitionById(tasks, F.pmod(F.col("part"), F.lit(tasks))).sortWithinPartitions("part", "kind")


def _asked(blobs: Iterator[np.ndarray], limits: Limits) -> Iterator[np.ndarray]:
    """Entries of a part -> those of anchors with several contexts, marked if they are ``heavy`` or more.

    Anchors that become heavy are let go while the part is read, so that no more than the others are held.
    """
    hot = np.empty(0, np.uint64)
    held, n, bound = [], 0, limits.held

    def settled(last: bool):
        nonlocal hot, held, n, bound
        e = np.concatenate(held)
        e = e[np.lexsort((e["pos"], e["th"], e["doc"], e["h"]))]
        e = e[np.r_[True, np.logical_or.reduce([e[f][1:] != e[f][:-1] for f in ("h", "doc", "th", "pos")])]]
        first = np.flatnonzero(np.r_[True, e["h"][1:] != e["h"][:-1]])
        size = np.diff(np.r_[first, len(e)])
        heavy = (size >= limits.heavy) | np.isin(e["h"][first], hot)
        hot = np.union1d(hot, e["h"][first[heavy]])
        e["hot"] = np.repeat(heavy, size)
        out = np.repeat(heavy | (size > 1) if last else heavy, size)
        held, n = [e[~out]], int((~out).sum())
        bound = max(limits.held, 2 * n)
        return e[out]

    for blob in blobs:
        held.append(blob)
        n += len(blob)
        if n >= bound:
            yield settled(False)
    if n:
        yield settled(True)


def repeated_ranges(docs: DataFrame, texts: DataFrame, parts: int, limits: Limits) -> list[DataFrame]:
    """Covered ranges, as blobs by document part. ``texts``: blobs of the documents by document part."""
    enough = min(limits.held, 16 * parts)  # entries that are dealt at once: blobs stay worth their while

    def collect_anchors(batches):
        entries, covers, n = [], [], 0

        def deal():
            e, c = np.concatenate(entries), _merged(np.concatenate(covers))
            return _batch([*_dealt(e, _part_of(e["h"], parts), ENTRY), *_dealt(c, _part_of(c["doc"], parts), COVER)])

        for table, data in _chunks(batches, limits.chunk):
            e, c = _folded(table, data, limits)
            entries.append(e)
            covers.append(c)
            n += len(e)
            if n >= enough:
                yield deal()
                entries, covers, n = [], [], 0
        if entries:
            yield deal()

    def settle(batches):
        for _, rows in _by_part(batches):
            covers = []

            def entries(rows=rows, covers=covers):
                for kind, data in rows:
                    if kind == ENTRY:
                        yield _unpack(data, ENTRIES)
                    else:
                        covers.append(_unpack(data, COVERS))

            for ask in _asked(entries(), limits):
                yield _batch(list(_dealt(ask, _part_of(ask["doc"], parts), ENTRY)))
            if covers:
                cover = _merged(np.concatenate(covers))
                yield _batch(list(_dealt(cover, _part_of(cover["doc"], parts), COVER)))

    def send(contexts):
        c = np.concatenate(contexts)
        part = _part_of(c["h"], parts)
        hot = c["hot"] > 0
        part[hot] = _part_of(c["h"][hot] + c["doc"][hot].astype(np.uint64) + c["pos"][hot].astype(np.uint64), parts)
        return _batch(list(_dealt(c, part, ENTRY)))

    def fetch(batches):
        for _, rows in _by_part(batches):
            asked, seen, contexts, held = [], set(), [], 0
            for kind, data in rows:
                if kind == ENTRY:
                    asked.append(_unpack(data, ENTRIES))
                    continue
                if isinstance(asked, list):
                    asked = np.concatenate(asked) if asked else np.empty(0, ENTRIES)
                    asked = asked[np.lexsort((asked["th"], asked["doc"]))]
                if not len(asked):
                    break
                table, raw = _unpack_texts(data)
                at = np.r_[0, table["size"].astype(np.int64).cumsum()]
                lo = np.searchsorted(asked["doc"], table["doc"], side="left")
                hi = np.searchsorted(asked["doc"], table["doc"], side="right")
                for i in np.flatnonzero(lo < hi).tolist():
                    doc, th, size = table[i].tolist()
                    if (doc, th) in seen:
                        continue
                    own = asked[lo[i] : hi[i]]
                    own = own[own["th"] == th]
                    if len(own):
                        seen.add((doc, th))
                        b = np.frombuffer(raw, np.uint8, size, int(at[i]))
                        c = np.empty(len(own), CONTEXT)
                        for f in ENTRIES.names:
                            c[f] = own[f]
                        c["bytes"] = b[np.clip(own["pos"].astype(np.int64)[:, None] - SIDE + np.arange(WIDTH), 0, size - 1)]
                        contexts.append(c)
                        held += len(own)
                    if held >= enough // 4 + limits.rows:
                        yield send(contexts)
                        contexts, held = [], 0
            if contexts:
                yield send(contexts)

    def expand(batches):
        for _, rows in _by_part(batches):
            c = np.concatenate([_unpack(d, CONTEXT) for _, d in rows])
            c = c[np.argsort(c["h"], kind="stable")]
            first = np.flatnonzero(np.r_[True, c["h"][1:] != c["h"][:-1]])
            sizes = np.diff(np.r_[first, len(c)])
            apart = (c["hot"][first] > 0) | (sizes > limits.rows)
            jobs, now, n = [], [], 0
            for a, m, large in zip(first, sizes, apart, strict=True):
                if large:
                    jobs += [(np.arange(s, min(s + limits.rows, a + m)), True) for s in range(a, a + m, limits.rows)]
                    continue
                if n + m > limits.rows:
                    jobs.append((np.concatenate(now), False))
                    now, n = [], 0
                now.append(np.arange(a, a + m))
                n += m
            if now:
                jobs.append((np.concatenate(now), False))
            for own, large in jobs:
                cover, windows = _expand(c[own], large)
                yield _batch([*_dealt(cover, _part_of(cover["doc"], parts), COVER), *_dealt(windows, _part_of(windows["w"], parts), WINDOW)])

    def compare(batches):
        for _, rows in _by_part(batches):
            w = np.concatenate([_unpack(d, WINDOWS) for _, d in rows])
            w = w[np.lexsort((w["start"], w["th"], w["doc"], w["w"]))]
            # windows of two anchors can be the same place
            w = w[np.r_[True, np.logical_or.reduce([w[f][1:] != w[f][:-1] for f in ("w", "doc", "th", "start")])]]
            late = w[_late_windows(w, limits.rows)]
            cover = _covers(late, late["start"], late["start"] + MIN_LENGTH)
            yield _batch(list(_dealt(cover, _part_of(cover["doc"], parts), COVER)))

    settled = materialize(_shuffle(docs.mapInArrow(tidy(collect_anchors), SCHEMA), parts).mapInArrow(tidy(settle), SCHEMA), "anchors")
    contexts = _shuffle(settled.where(F.col("kind") == ENTRY).unionByName(texts), parts).mapInArrow(tidy(fetch), SCHEMA)
    expanded = materialize(_shuffle(contexts, parts).mapInArrow(tidy(expand), SCHEMA), "classes")
    covers = [settled.where(F.col("kind") == COVER), expanded.where(F.col("kind") == COVER)]
    windows = expanded.where(F.col("kind") == WINDOW)
    if not windows.isEmpty():  # only anchors dealt over several transforms leave windows to compare
        covers.append(_shuffle(windows, parts).mapInArrow(tidy(compare), SCHEMA))
    return covers


def _unpack_texts(data: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little") * TEXTS.itemsize
    return np.frombuffer(raw, TEXTS, n // TEXTS.itemsize, 8), raw[8 + n :]


def _text_blobs(docs: DataFrame, parts: int, limits: Limits) -> DataFrame:
    def pack(batches):
        compress = zstandard.ZstdCompressor(level=1).compress
        for table, data in _chunks(batches, limits.chunk):
            at = np.r_[0, table["size"].astype(np.int64).cumsum()].tolist()
            part = _part_of(table["doc"], parts)
            order = np.argsort(part, kind="stable")
            out = []
            for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                body = b"".join([data[at[i] : at[i + 1]] for i in own.tolist()])
                out.append((int(part[own[0]]), TEXT, compress(len(own).to_bytes(8, "little") + table[own].tobytes() + body)))
            yield _batch(out)

    return docs.mapInArrow(tidy(pack), SCHEMA)


def remove_repeats(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (removed ranges start, end, in bytes), kept (the remaining bytes) of every document."""
    limits = limits or Limits()
    text: Column = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    per_part = min(max(limits.part[0], size >> 16), limits.part[1])
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // per_part)
    texts = _text_blobs(docs, parts, limits)
    covers = repeated_ranges(docs, texts, parts, limits)

    def cut(batches):
        for _, rows in _by_part(batches):
            covered, seen = [], set()
            for kind, data in rows:
                if kind == COVER:
                    covered.append(_unpack(data, COVERS))
                    continue
                if isinstance(covered, list):
                    covered = _merged(np.concatenate(covered) if covered else np.empty(0, COVERS))
                table, raw = _unpack_texts(data)
                lo = np.searchsorted(covered["doc"], table["doc"], side="left")
                hi = np.searchsorted(covered["doc"], table["doc"], side="right")
                ids, sizes, spans, kept, at = [], [], [], [], 0
                for (doc, th, n), a, z in zip(table.tolist(), lo, hi, strict=True):
                    own = covered[a:z]
                    out = [(int(s), int(e)) for s, e in zip(own["start"], own["end"], strict=True)] if a < z and (own["th"] == th).all() else [(int(r["start"]), int(r["end"])) for r in own if r["th"] == th]
                    if (doc, th) in seen and n >= MIN_LENGTH:
                        out = [(0, n)]
                    seen.add((doc, th))
                    left, left_at = [], 0
                    for s, e in out:
                        left.append(raw[at + left_at : at + s])
                        left_at = e
                    left.append(raw[at + left_at : at + n])
                    ids.append(None if doc == NULL_ID else doc)
                    sizes.append(n)
                    spans.append([{"start": s, "end": e} for s, e in out])
                    kept.append(b"".join(left))
                    at += n
                kind_of = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, kind_of), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    rows = texts
    for c in covers:
        rows = rows.unionByName(c)
    return _shuffle(rows, parts).mapInArrow(tidy(cut), "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
