"""Operator 10, best-fit packing with large-item matching.

Documents become token ids and one end id; only longer ones than the
capacity are cut. Pieces above a third of the capacity are matched greedily:
each, from the longest on, takes the longest other that still fits, so at
most two share a sequence. Smaller pieces, from the longest on, go to the
sequence with the smallest gap that holds them, and open a new one where
none does.

Lengths are whole numbers up to the capacity, so the whole plan is a
function of the number of pieces of each length: the driver gets that count
table (at most ``capacity`` rows, whatever the corpus) and returns runs
"pieces i to j of length n go to sequences s, s+1, ... at offset o". Tasks
number the pieces of a length by salted groups and look their run up. A
length that a third of all pieces share is numbered by many tasks, and no
text moves through a shuffle.

Cases: a null or empty text is the end id alone; a text of any length is cut
into pieces of ``capacity`` ids, the last may be shorter; rows that repeat a
doc_id are pieces of their own; an empty table gives an empty result. Other
columns of the input are not read.
"""

from __future__ import annotations

import string
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored, table, word_blocks

CAPACITY, END_ID = 4096, 1
CACHE_WORDS = 400_000  # words that a Python worker remembers before it starts anew,
LONG_WORD = 64         # of at most so many bytes


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids of texts, word by word: the tokenizer never joins anything
    across white space, so the ids of a text are those of its words. Most
    words are letters and a tail of ASCII punctuation, two pieces to the
    tokenizer's splitter; those go to its merges directly."""

    _open: dict[str, WordIds] = {}
    _tail = string.punctuation.encode()

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.merge, self.normal = self.tokenizer.model.tokenize, self.tokenizer.normalizer.normalize_str
        top = max(self.tokenizer.get_vocab().values())
        self.coded = [i.to_bytes(4, "little") for i in range(top + 1)]
        # byte-level form: printable Latin-1 stands for itself, other bytes for 256, 257, ... in order
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.byte_level = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in shown)}
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}  # the words known before ``known`` was begun anew
        self.tails: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordIds:
        """One per Python worker, kept from task to task."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def merged(self, form: str) -> bytes:
        return b"".join([self.coded[t.id] for t in self.merge(form)])

    def learn(self, word: bytes) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            run = word.rstrip(self._tail) if len(word) <= LONG_WORD else b""
            if run.isalpha():  # ASCII letters only
                ids = self.merged(run.lower().decode())
            elif (form := self.normal(run.decode())).isalpha():
                ids = self.merged(form.encode().decode("latin-1").translate(self.byte_level))
            if ids is None:
                ids = b"".join([self.coded[i] for i in self.tokenizer.encode(word.decode(), add_special_tokens=False).ids])
            elif len(run) < len(word):
                tail = word[len(run):]
                if tail not in self.tails:
                    self.tails[tail] = self.merged(tail.decode())
                ids += self.tails[tail]
        if len(word) <= LONG_WORD:
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.before, self.tails = {}, self.known, {}
        out = []
        for words in word_blocks(text.encode()):
            ids = list(map(self.known.get, words))
            if None in ids:
                ids = [self.learn(w) if i is None else i for i, w in zip(ids, words)]
            out.append(b"".join(ids))
        return out[0] if len(out) == 1 else b"".join(out)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY,
                 end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids themselves as
    little-endian bytes with ``keep_ids``), one row per piece."""
    path = path or tokenizer_path()
    end = np.asarray([end_id], "<u4").tobytes()
    width = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = WordIds.of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = [[], [], [], [], [], []]
                for doc_id, ids in zip(part.column(0).to_pylist(), map(coder.encode, part.column(1).to_pylist())):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), width)):
                        own = ids[start:start + width]
                        for col, value in zip(rows, (doc_id, piece, start // 4, len(own) // 4, zlib.crc32(own),
                                                     own if keep_ids else None)):
                            col.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                made = [pa.array(c, t) for c, t in zip(rows, kinds)]
                yield pa.RecordBatch.from_arrays(made[:5 + keep_ids], names[:5 + keep_ids])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return read.mapInArrow(cut, PIECES + (", ids binary" if keep_ids else ""))


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first, last, sequence, each, offset) and the number of
    sequences: piece ``i`` of a length, ``first <= i < last``, goes to
    sequence ``sequence + (i - first) // each`` at
    ``offset + (i - first) % each * length``."""
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, how many)
    order: list[int] = []                        # gaps in use, ascending
    sequences = 0

    def place(n: int, c: int, sequence: int, each: int, offset: int) -> None:
        runs.append((n, used[n], used[n] + c, sequence, each, offset))
        used[n] += c
        left[n] -= c

    def leave(gap: int, sequence: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((sequence, n))

    lengths = sorted(left)
    large = [n for n in lengths if 3 * n > capacity]
    for a in reversed(large):
        while left[a]:
            at = bisect_left(large, capacity - a + 1) - 1
            while at >= 0 and not left[large[at]]:
                at -= 1
            b = large[at] if at >= 0 else 0
            if not b or (b == a and left[a] == 1):
                # alone, or no second of its own length: the next shorter one
                at -= 1
                while b and at >= 0 and not left[large[at]]:
                    at -= 1
                b = large[at] if b and at >= 0 else 0
            n = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
            place(a, n, sequences, 1, 0)
            if b:
                place(b, n, sequences, 1, a)
            leave(capacity - a - b, sequences, n)
            sequences += n
    for n in reversed([x for x in lengths if 3 * x <= capacity]):
        while left[n]:
            at = bisect_left(order, n)
            if at == len(order):
                each = capacity // n
                full, over = divmod(left[n], each)
                for bins, many in ((full, each), (1, over)):
                    if bins and many:
                        place(n, bins * many, sequences, many, 0)
                        leave(capacity - many * n, sequences, bins)
                        sequences += bins
                continue
            gap = order[at]
            sequence, bins = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            each = gap // n
            full = min(bins, left[n] // each)
            if full:
                place(n, full * each, sequence, each, capacity - gap)
                leave(gap - each * n, sequence, full)
            if full < bins and left[n]:  # the rest of this length fits one more
                many = left[n]
                place(n, many, sequence + full, many, capacity - gap)
                leave(gap - many * n, sequence + full, 1)
                full += 1
            leave(gap, sequence + full, bins - full)
    return runs, sequences


PACKED = PIECES + ", sequence_id long, offset long"


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, path, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in  # at most `capacity` rows
              pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan_runs(counts, capacity)
    salts = spark.createDataFrame([(n, isqrt(c) + 1) for n, c in counts.items()], "length long, _salts long")

    # number the pieces of each length: by salted group (as many as a group has rows), then the groups' starts
    salted = pieces.join(F.broadcast(salts), "length")  # at most `capacity` rows
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "_salts"))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(F.col("length").alias("_length"), F.col("_salt").alias("_s"),
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    starts = stored(starts, "starts")
    own = W.partitionBy("length", "_salt").orderBy(F.col("doc_id").asc_nulls_last(), "piece")
    numbered = salted.withColumn("_nth", F.row_number().over(own) - 1)
    numbered = numbered.join(starts, (numbered["length"] == starts["_length"]) & (numbered["_salt"] == starts["_s"]))
    numbered = numbered.withColumn("_nth", (F.col("_first") + F.col("_nth")).cast("long"))

    # runs sorted by length and first piece; (length << 44 | first) finds a piece's run
    table_of = np.asarray(sorted(runs), "i8").reshape(-1, 6)
    shared = spark.sparkContext.broadcast(table_of)  # a few thousand rows: bounded by the capacity

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = shared.value
        keys = (run[:, 0] << 44) | run[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, nth = (np.asarray(batch.column(c)) for c in ("length", "_nth"))
            at = run[np.searchsorted(keys, (length << 44) | nth, side="right") - 1]
            off = nth - at[:, 1]
            sequence = at[:, 3] + off // at[:, 4]
            offset = at[:, 5] + off % at[:, 4] * length
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "_nth").mapInArrow(seat, PACKED)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
