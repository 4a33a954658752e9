"""Operator 2, substring dedup with repeated-phrase automata.

A window is ``WINDOW`` consecutive words of a document; a word goes if it is
in a window whose words also start in a document with a smaller doc_id.

1. Candidates. Of every window, the gram (``GRAM`` words) with the smallest
   hash is its anchor, so equal windows have equal anchors wherever they
   stand, and a document has few of them (two in ``WINDOW - GRAM + 2``
   words, about). Only anchors of two or more documents go on.
2. Confirmation. Documents with candidates are dealt out into slices of
   bounded size. Around their anchors, every window is counted by its own
   hash and the slice, then over the slices: a window of two or more
   documents recurs, its first document is known, and so are the slices that
   have it. Consecutive recurring windows of their first document are
   passages, of ``PIECE`` windows at most.
3. Automata. A slice gets the passages that share a window with one of its
   documents of larger id, so what is sent to it is bounded by the windows
   of its own documents, however many others share a phrase shorter than a
   window. Of each block of half a window it compiles the
   first half, a phrase, into a pyahocorasick automaton (any window of a
   passage holds a whole block) and streams its documents through it. The
   windows around each phrase that occurs are looked up among the passages'
   windows and, run by run, compared as text; they are covered if the
   passage's document is smaller.

Windows are judged on the input. A passage that a third of all documents
share is one pattern in each slice, so no task gets its occurrences alone.
Documents without a repeated anchor need no automaton and move no text.

Cases: a null text has no words; texts shorter than a window lose nothing;
very long texts are one row but read and hashed by arrays; rows that repeat
a doc_id never remove each other's words; a null doc_id counts as larger
than any other; such rows are told apart by their texts and dealt out over
all slices, equal ones too; an empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import shuffle_partitions, stored, table

WINDOW, GRAM = 50, 16
SLICE_ANCHORS = 16_000  # repeated anchors of the documents of a slice, about
PIECE = 256            # windows of a passage, at most
LAST_ID = 2 ** 63 - 1  # stands for a null doc_id
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2 ** 64)
_STEP = 1 << 15        # anchors are searched in steps of so many windows

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept and doubled as needed."""
    known = _powers.get(base, np.ones(1, np.uint64))
    while len(known) < n:
        known = np.concatenate([known, known * np.uint64(pow(base, len(known), 2 ** 64))])
    _powers[base] = known
    return known[:n]


class Words:
    """The words of a text with hashes of their runs."""

    def __init__(self, text: str):
        from xxhash import xxh64_intdigest
        self.words = text.encode().split()
        n = len(self.words)
        self.hashes = np.fromiter(map(xxh64_intdigest, self.words), np.uint64, n)
        self._sums = np.concatenate(([np.uint64(0)], np.cumsum(self.hashes * powers(_BASE, n), dtype=np.uint64)))

    def runs(self, size: int) -> np.ndarray:
        """The hash of every run of ``size`` words."""
        n = len(self.words) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = (self._sums[size:] - self._sums[:-size]) * powers(_INVERSE, n)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(32)

    def anchors(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """For every window, the place and the hash of its anchor."""
        grams, width = self.runs(gram), window - gram + 1
        n = max(0, len(self.words) - window + 1)
        at = np.empty(n, np.int64)
        for i in range(0, n, _STEP):
            j = min(n, i + _STEP)
            at[i:j] = np.arange(i, j) + sliding_window_view(grams[i:j + width - 1], width).argmin(1)
        return at, grams[at] if n else grams[:0]


def document_anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, row, id): the distinct anchors of every document."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                anchors, counts = [np.zeros(0, np.uint64)], []
                for text in part.column(2).to_pylist():
                    anchors.append(np.unique(Words(text).anchors(window, gram)[1]))
                    counts.append(len(anchors[-1]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchors).view(np.int64)),
                                                  *(pa.array(np.repeat(np.asarray(part.column(c)), counts)) for c in (0, 1))],
                                                 ["anchor", "row", "id"])

    return docs.select("row", "id", "text").mapInArrow(rows, "anchor long, row long, id long")


def packed(docs: DataFrame) -> DataFrame:
    """The documents with compressed text."""
    from zstandard import ZstdCompressor

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = ZstdCompressor(level=3).compress
        for batch in batches:
            made = pa.array([zip_(t.as_py().encode()) for t in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), made], ["row", "id", "doc_id", "packed"])

    return docs.select("row", "id", "doc_id", "text").mapInArrow(rows, "row long, id long, doc_id long, packed binary")


def candidate_windows(candidates: DataFrame, window: int, gram: int) -> DataFrame:
    """(window, slice, id, at): every window with a repeated anchor."""
    from zstandard import ZstdDecompressor

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = ZstdDecompressor().decompress
        for batch in batches:
            for part, i, data, anchors in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                own = Words(unzip(data.as_py()).decode())
                repeated = np.asarray(anchors.values).view(np.uint64)
                at = np.flatnonzero(np.isin(own.anchors(window, gram)[1], repeated))
                yield pa.RecordBatch.from_arrays([
                    pa.array(own.runs(window)[at].view(np.int64)), pa.array(np.full(len(at), part, np.int64)),
                    pa.array(np.full(len(at), i, np.int64)), pa.array(at)], ["window", "slice", "id", "at"])

    return candidates.select("slice", "id", "packed", "anchors").mapInArrow(rows, "window long, slice long, id long, at long")


def recurring_windows(candidates: DataFrame, window: int, gram: int) -> DataFrame:
    """(slice, last, id, at, lead): per recurring window and slice that has it
    the largest id there and the window's first document and place; ``lead``
    marks one row of each window. A window that a third of all documents share
    is combined per slice first, then has one row per slice."""
    per = candidate_windows(candidates, window, gram).groupBy("window", "slice").agg(
        F.min("id").alias("id"), F.min_by("at", "id").alias("at"), F.max("id").alias("last"))
    of = W.partitionBy("window")
    first = per.withColumn("_n", F.row_number().over(of.orderBy("id", "slice"))).select(
        "slice", "last", F.first("id").over(of.orderBy("id", "slice")).alias("id"),
        F.first("at").over(of.orderBy("id", "slice")).alias("at"), (F.col("_n") == 1).alias("lead"),
        F.max("last").over(of).alias("_most"))
    return first.where("id < _most").drop("_most")


def passages(recurring: DataFrame, candidates: DataFrame, window: int, piece: int) -> DataFrame:
    """(id, piece, passage): runs of recurring windows in their first
    document, with their words. ``piece`` numbers the stretches of so many
    places that a run starts and ends in."""
    from zstandard import ZstdCompressor, ZstdDecompressor

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_, unzip = ZstdCompressor(level=3).compress, ZstdDecompressor().decompress
        for batch in batches:
            out = ([], [], [])
            for i, data, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words = unzip(data.as_py()).split()
                at = np.sort(np.asarray(found.values))
                for run in np.split(at, np.flatnonzero((np.diff(at) > 1) | (np.diff(at // piece) != 0)) + 1):
                    if run[0] + window > len(words):
                        continue  # found in another text of this id
                    for col, value in zip(out, (i, int(run[0]) // piece, zip_(b" ".join(words[run[0]:run[-1] + window])))):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())],
                                             ["id", "piece", "passage"])

    of = recurring.where("lead").groupBy("id").agg(F.collect_list("at").alias("found"))
    # every text that an id has gives passages; a repeated row gives the same ones
    return candidates.select("id", "packed").join(of, "id").select("id", "packed", "found").mapInArrow(
        rows, "id long, piece long, passage binary").dropDuplicates(["id", "piece", "passage"])


class Automaton:
    """The passages of a slice: the phrases that lead to them, and their
    windows by hash."""

    def __init__(self, window: int):
        import ahocorasick
        self.window, self.block = window, window // 2
        self.phrase = max(1, self.block // 2)
        self.machine = ahocorasick.Automaton()
        self.passages: list[tuple[str, np.ndarray]] = []  # text, place of each word
        self.parts: list[tuple] = []                      # of each: hashes, id, number, place of its windows
        self.windows: tuple | None = None                 # all of them, by hash, then id

    def add(self, i: int, text: str) -> None:
        own = Words(text)
        joined, starts = spaced(own.words)
        for at in range(0, len(own.words) - self.block + 1, self.block):
            pattern = joined[starts[at] - 1:starts[at + self.phrase]]
            self.machine.add_word(pattern, len(pattern))
        hashes = own.runs(self.window)
        n = len(hashes)
        self.parts.append((hashes, np.full(n, i, np.int64), np.full(n, len(self.passages)), np.arange(n)))
        self.passages.append((joined, starts))

    def compile(self) -> None:
        self.machine.make_automaton()
        hashes, ids, number, at = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, hashes))
        self.windows = hashes[order], ids[order], number[order], at[order]
        self.parts = []

    def covered(self, i: int, own: Words) -> np.ndarray:
        """Which words of document ``i`` are in a window of a passage of a
        document with a smaller id."""
        n = len(own.words) - self.window + 1
        cover = np.zeros(len(own.words), bool)
        if not self.passages or n <= 0:
            return cover
        if self.windows is None:
            self.compile()
        joined, starts = spaced(own.words)
        found = [end - length for end, length in self.machine.iter(joined)]  # before each phrase's first space
        if not found:
            return cover
        word = np.searchsorted(starts, np.array(found) + 2)
        # the windows that hold a phrase where it occurs
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, np.maximum(0, word + self.phrase - self.window), 1)
        np.add.at(change, np.minimum(n, word + 1), -1)
        at = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        hashes, ids, number, place = self.windows
        own_hashes = own.runs(self.window)[at]
        first = np.searchsorted(hashes, own_hashes)
        same = first < len(hashes)
        same[same] = hashes[first[same]] == own_hashes[same]
        same[same] = ids[first[same]] < i  # ids ascend within a hash
        at, first = at[same], first[same]
        # runs of windows along one diagonal of one passage are compared as one text
        shift = place[first] - at
        cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(shift) != 0) | (np.diff(number[first]) != 0)) + 1
        for run, hit in zip(np.split(at, cuts), np.split(first, cuts)):
            if not len(run):
                continue
            if self.equal(joined, starts, run[0], number[hit[0]], place[hit[0]], len(run) + self.window - 1):
                cover[run[0]:run[-1] + self.window] = True
            else:  # two windows of one hash
                for a, k in zip(run, hit):
                    while k < len(hashes) and hashes[k] == hashes[hit[a - run[0]]] and ids[k] < i:
                        if self.equal(joined, starts, a, number[k], place[k], self.window):
                            cover[a:a + self.window] = True
                            break
                        k += 1
        return cover

    def equal(self, joined: str, starts: np.ndarray, at: int, number: int, place: int, words: int) -> bool:
        text, places = self.passages[number]
        return joined[starts[at]:starts[at + words]] == text[places[place]:places[place + words]]


def spaced(words: list[bytes]) -> tuple[str, np.ndarray]:
    """The words with a space before, between and after, and the place of
    the character after each space: where each word starts, and the end."""
    joined = b" " + b" ".join(words) + b" "
    data = np.frombuffer(joined, np.uint8)
    starts = np.flatnonzero(data == 0x20) + 1
    if not joined.isascii():  # from bytes to characters
        starts = np.cumsum((data & 0xC0) != 0x80)[starts - 1]
    return joined.decode(), starts


REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def slice_stream(rows_in: DataFrame, window: int, keep_text: bool) -> DataFrame:
    """Compile the passages of each slice, then stream its documents."""
    from zstandard import ZstdDecompressor

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * keep_text
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * keep_text

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = ZstdDecompressor().decompress
        current, machine, done = None, None, []
        for batch in batches:
            cols = [batch.column(i) for i in range(5)]
            for at, kind, i, doc_id, data in zip(*(c.to_pylist() for c in cols)):
                if at != current:
                    current, machine = at, Automaton(window)
                text = unzip(data).decode()
                if kind == 0:
                    machine.add(i, text)
                    continue
                own = Words(text)
                cover = machine.covered(i, own)
                kept = b" ".join([w for w, gone in zip(own.words, cover.tolist()) if not gone])
                row = (doc_id, len(own.words), int(cover.sum()), hashlib.sha256(kept).hexdigest())
                done.append(row + ((kept.decode(),) if keep_text else ()))
                if len(done) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names)
                    done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names)

    n = shuffle_partitions(rows_in.sparkSession)
    dealt = rows_in.repartition(n, "slice").sortWithinPartitions("slice", "kind", "id", "doc_id")
    return dealt.select("slice", "kind", "id", "doc_id", "data").mapInArrow(rows, REMOVED + (", text string" if keep_text else ""))


def untouched(docs: DataFrame, keep_text: bool) -> DataFrame:
    """The result of documents that lose nothing."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                words = [t.encode().split() for t in part.column(2).to_pylist()]
                kept = [b" ".join(w) for w in words]
                cols = [part.column(0), part.column(1), pa.array([len(w) for w in words], pa.int64()),
                        pa.array([0] * len(words), pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array([k.decode() for k in kept], pa.string())] * keep_text,
                                                 ["row", "doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * keep_text)

    return docs.select("row", "doc_id", "text").mapInArrow(rows, "row long, " + REMOVED + (", text string" if keep_text else ""))


def dealt_out(docs: DataFrame, window: int, gram: int, slice_anchors: int, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """The documents with repeated anchors and their slices, and the passages
    that each slice needs."""
    # 1. anchors of two or more documents, and the documents that have them
    anchors = stored(document_anchors(docs, window, gram), "anchors")
    repeated = stored(anchors.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b"))
                      .where("a < b").select("anchor"), "repeated")
    hits = stored(anchors.join(repeated, "anchor", "left_semi").select("anchor", "row"), "hits")
    of = hits.groupBy("row").agg(F.collect_set("anchor").alias("anchors"))
    # 2. slices of bounded size; a document's is drawn as it is stored, so rows that are equal are spread too
    slices = max(1, -(-hits.count() // slice_anchors))
    drawn = F.pmod(F.xxhash64("row", F.monotonically_increasing_id()), F.lit(slices))
    candidates = stored(packed(docs).join(of, "row").withColumn("slice", drawn), "candidates")
    # recurring windows, as passages of their first document, and the slices that have them
    recurring = stored(recurring_windows(candidates, window, gram), "recurring")
    found = passages(recurring, candidates, window, piece)
    needed = (recurring.where("last > id")
              .select("slice", "id", F.floor(F.col("at") / F.lit(piece)).cast("long").alias("piece")).distinct())
    return candidates, needed.join(found, ["id", "piece"]).select("slice", "id", "passage")


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, the id that orders it, text, and a hash of both that stands for the row."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.xxhash64(doc_id, text).alias("row"), F.coalesce(doc_id, F.lit(LAST_ID)).alias("id"),
                       doc_id.alias("doc_id"), text.alias("text"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, slice_anchors: int = SLICE_ANCHORS,
                   keep_text: bool = False, piece: int = PIECE) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and the
    kept text with ``keep_text``)."""
    docs = numbered(docs)
    candidates, needed = dealt_out(docs, window, gram, slice_anchors, piece)
    # 3. each slice's passages, then its documents
    compiled = needed.select("slice", F.lit(0).alias("kind"), "id", F.lit(None).cast("long").alias("doc_id"), F.col("passage").alias("data"))
    streamed = candidates.select("slice", F.lit(1).alias("kind"), "id", "doc_id", F.col("packed").alias("data"))
    done = slice_stream(compiled.unionByName(streamed), window, keep_text)
    rest = untouched(docs, keep_text).join(candidates.select("row").distinct(), "row", "left_anti").drop("row")
    return done.unionByName(rest)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLE_SQL = {"op2_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 49)) AS s, w FROM d WHERE len(w) >= 50
), keyed AS (
  SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS k FROM windows
), repeats AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY k) AS f FROM keyed) WHERE f < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(s, s + 49)) AS i FROM repeats
), lists AS (
  SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id)
"""}
