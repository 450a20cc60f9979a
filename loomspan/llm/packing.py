"""Best-fit packing of token sequences by large-item matching.

Documents are tokenized once and cut into pieces of at most ``capacity`` tokens, written out with their
ids. As only ``capacity`` different lengths exist, the packing is decided on the histogram of lengths, whose
size does not depend on the corpus: lengths above a third of the capacity are matched greedily, at most
two in a sequence (the longest with the longest that fits beside it); shorter ones go, longest first, to
the fullest sequence with room, and open a new one where none has. The plan is a short table of runs
(length, ranks -> sequences, offset); each piece gets its rank among equal lengths from a count by task
of the tokenizing stage, and looks itself up in the broadcast plan. Ranks are exact, no group is gathered.

Defined results: null and empty texts are one piece that holds the end id alone; repeated rows are packed
each; equal lengths are placed in the order of tasks and rows; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import materialize, small_batches, tidy

CAPACITY, END_ID = 4096, 1
#: So many word forms are remembered by a task; then it starts anew. A bound on memory, not on results.
CACHE = 400_000
#: Documents tokenized at once.
SLICE = 1000
_LETTERS, _MARKS = "[A-Za-zªµºÀ-ÖØ-öø-ÿ]+", "[.,;:!?*#$%&]"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Token ids of whole texts, in bulk.

    The tokenizer never merges across white space, so each white-space separated word form is encoded
    once by the library and remembered.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode = tokenizer.encode_batch_fast
        self.closes = np.zeros(tokenizer.get_vocab_size(), bool)
        self.closes[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text followed by END_ID, and where each text ends."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = words.flatten().dictionary_encode()
        # letters of Latin-1 and marks behind them are pieces of their own, and lower-cased alike
        forms = coded.dictionary
        behind = pc.replace_substring_regex(forms, f"^{_LETTERS}", "")
        parted = pc.match_substring_regex(forms, f"^{_LETTERS}{_MARKS}*$")
        keys = pc.if_else(parted, pc.utf8_lower(pc.replace_substring_regex(forms, f"{_MARKS}*$", "")), forms).dictionary_encode()
        marks = pc.if_else(parted, behind, "").dictionary_encode()
        if len(self.known) > CACHE:
            self.known = {"": b""}
        self._learn(keys.dictionary)
        self._learn(marks.dictionary)
        first = [self._table(x.dictionary) for x in (keys, marks)]
        both = np.stack([x.indices.to_numpy(zero_copy_only=False) for x in (keys, marks)], axis=1)
        both[:, 1] += len(keys.dictionary)  # each form is a key and its marks
        table, at = _gather(np.concatenate([t for t, _ in first]), np.concatenate([n for _, n in first]), both.ravel())
        size = np.diff(at[::2])
        flat, upto = _gather(table, size, coded.indices.to_numpy(zero_copy_only=False))
        counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
        ends = upto[counts]
        return np.insert(flat, ends, END_ID).astype("<u4"), ends + np.arange(1, len(ends) + 1)

    def _table(self, forms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the forms, one after the other, and how many each has."""
        ids = list(map(self.known.__getitem__, forms.to_pylist()))
        return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4

    def _learn(self, forms: pa.Array) -> None:
        known = self.known
        new = forms.filter(pa.array([w not in known for w in forms.to_pylist()], pa.bool_()))
        simple = pc.match_substring_regex(new, f"^{_LETTERS}$")
        one = new.filter(simple).to_pylist()
        if one:  # one call for all: each is one piece, whose last token closes a word
            flat = np.array(self.encode([" ".join(one)], add_special_tokens=False)[0].ids, "<u4")
            ends = ((np.flatnonzero(self.closes[flat]) + 1) * 4).tolist()
            data = flat.tobytes()
            known.update((w, data[s:e]) for w, s, e in zip(one, [0, *ends], ends, strict=False))
        rest = new.filter(pc.invert(simple)).to_pylist()
        for w, e in zip(rest, self.encode(rest, add_special_tokens=False), strict=True):
            known[w] = array("I", e.ids).tobytes()


def _gather(table: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``code`` of a ragged table, one after the other, and where each begins (and the last ends)."""
    first, long = np.r_[0, size.cumsum()], size[code]
    upto = np.r_[0, long.cumsum()]
    return table[np.repeat(first[code] - upto[:-1], long) + np.arange(upto[-1])], upto


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, with what it remembers."""
    return WordTokenizer(path)


def tokenize(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """uid, doc_id, piece, start, length, ids (binary, little-endian 32 bits), task, nth (rank in task and length)."""
    path = tokenizer or default_tokenizer()
    schema = T.StructType(
        [
            T.StructField("uid", T.LongType()),
            docs.select("doc_id").schema[0],
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("task", T.IntegerType()),
            T.StructField("nth", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task, row = _tokenizer(path), TaskContext.get().partitionId(), 0
        seen = [0] * (capacity + 1)
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                at, piece, start, length, ids, nth = [], [], [], [], [], []
                flat, ends = tokens(batch.column(1))
                whole_ids, begin = flat.tobytes(), 0
                for i, stop in enumerate(ends.tolist()):
                    for k, s in enumerate(range(begin, stop, capacity)):
                        n = min(capacity, stop - s)
                        at.append(i)
                        piece.append(k)
                        start.append(s - begin)
                        length.append(n)
                        ids.append(whole_ids[4 * s : 4 * (s + n)])
                        nth.append(seen[n])
                        seen[n] += 1
                    begin = stop
                uid = (np.array(at, np.int64) + row) | (task << 40)
                row += batch.num_rows
                columns = [pa.array(uid), batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array([task] * len(at), pa.int32()), pa.array(nth, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    with small_batches(docs.sparkSession):
        return materialize(docs.select("doc_id", "text").mapInArrow(tidy(run), schema), "tokens")


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """counts: pieces by length. -> rows (length, first rank, items, first sequence, offset), sequences used.

    The i-th item of a row goes to the i-th sequence from the first on.
    """
    left = np.zeros(capacity + 1, np.int64)
    for k, v in counts.items():
        left[k] = v
    rank = np.zeros(capacity + 1, np.int64)
    rows, bins = [], 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs of sequences (first, number)

    def put(length: int, first: int, number: int, offset: int) -> None:
        rows.append((length, int(rank[length]), number, first, offset))
        rank[length] += number
        left[length] -= number

    least = capacity // 3 + 1
    for a in range(capacity, least - 1, -1):
        while left[a]:
            fits = np.flatnonzero(left[least : min(a, capacity - a) + 1]) if capacity - a >= least else []
            b = int(fits[-1]) + least if len(fits) else None
            n = int(left[a]) if b is None else int(left[a]) // 2 if a == b else int(min(left[a], left[b]))
            if b == a and n == 0:  # a single one is left; a shorter one may fit beside it
                b = int(fits[-2]) + least if len(fits) > 1 else None
                n = 1
            put(a, bins, n, 0)
            if b is not None:
                put(b, bins, n, a)
            gaps[capacity - a - (b or 0)].append((bins, n))
            bins += n
    for a in range(least - 1, 0, -1):
        sizes = sorted(g for g in gaps if g >= a and gaps[g])
        while left[a]:
            gap = sizes.pop(0) if sizes else capacity
            each = gap // a
            runs = gaps.pop(gap, []) if gap < capacity else []
            if gap == capacity:
                need = -(-int(left[a]) // each)
                runs, bins = [(bins, need)], bins + need
            while runs and left[a]:
                first, number = runs.pop()
                full = min(number, int(left[a]) // each)
                if full:
                    for j in range(each):
                        put(a, first, full, capacity - gap + j * a)
                    gaps[gap - each * a].append((first, full))
                    first, number = first + full, number - full
                if number and (rest := int(left[a])) and rest < each:
                    for j in range(rest):
                        put(a, first, 1, capacity - gap + j * a)
                    gaps[gap - rest * a].append((first, 1))
                    first, number = first + 1, number - 1
                if number:
                    runs.append((first, number))
            if runs:
                gaps[gap].extend(runs)
    return np.array(sorted(rows), np.int64).reshape(-1, 5), bins


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows with length, task and nth (from ``tokenize``; task and nth are dropped)."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("task", "length").agg((F.max("nth") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "lengths")
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table, _ = plan_bins(total, capacity)
    starts = (table[:, 0] << 44) | table[:, 1]
    shared = spark.sparkContext.broadcast((starts, table))

    names = [c for c in pieces.columns if c not in ("task", "nth")]
    on = counts.select(F.col("task").alias("_t"), F.col("length").alias("_l"), "before").hint("merge")
    ranked = pieces.join(on, (F.col("task") == F.col("_t")) & (F.col("length") == F.col("_l")))
    ranked = ranked.select(*names, (F.col("before") + F.col("nth")).alias("_rank"))
    schema = T.StructType([ranked.schema[c] for c in names] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, table = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            row = table[np.searchsorted(starts, (length << 44) | rank, side="right") - 1]
            columns = [*[batch.column(c) for c in names], pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return ranked.mapInArrow(tidy(look_up), schema)


def sequences(tokens: DataFrame, placed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves (each at most the capacity)."""
    at = placed.select("uid", "piece", "sequence_id", "offset")
    parts = tokens.select("uid", "piece", "ids").join(at, ["uid", "piece"])
    rows = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return parts.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(rows, lambda x: x["ids"]), "")).alias("ids"))


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    tokens = tokenize(docs, tokenizer, capacity)
    digest = tokens.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "task", "nth")
    return place(digest, capacity)
