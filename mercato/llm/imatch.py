"""Operator 8, I-Match document fingerprints.

Terms (white-space words, A-Z lower-cased, without ASCII punctuation
around them) are kept if their inverse
document frequency is in a band: they are in at least ``MIN_SHARE`` of all
documents, which bounds the lexicon (a document of k distinct terms adds k
to the frequencies, so at most ``mean k / MIN_SHARE`` terms qualify), and in
at most ``MAX_SHARE``. A document's distinct terms of the lexicon, sorted,
are hashed once for each of several random sub-lexicons; sub-lexicons of
falling density let texts of any length keep some hashes after an edit. The
fingerprint is the row of these hashes. Likeness is the share of equal
hashes among the sub-lexicons that either text has a term of.

For the query, every document also needs the one that follows it in
descending doc_id. Documents are dealt out by ranges of doc_id (ranges from
approximate quantiles of the id column), compressed, each once; the first
document of a range is also sent to the range before it. A task streams its
range in order and holds two documents.

Cases: a null text counts as empty; a text without terms of the lexicon has
the fingerprint of zeros; two such are alike (1.0), one such and another are
not (0.0); a single document is followed by itself; a null doc_id comes
last; rows of equal doc_id stand in a fixed order; an empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, table, word_blocks

MIN_SHARE, MAX_SHARE = 1e-3, 0.25  # the band, as shares of all documents
# sub-lexicons: the share of the lexicon that each keeps
DENSITIES = [1 / 8] * 8 + [1 / 32] * 16 + [1 / 128] * 32 + [1 / 512] * 64
PUNCTUATION = string.punctuation.encode()
FLUSH_TERMS = 200_000
NO_ID = -2 ** 63  # stands for a null doc_id, last in descending order


def terms_of(text: str) -> set[bytes]:
    out: set[bytes] = set()
    for words in word_blocks(text.encode().lower()):
        out.update([w.strip(PUNCTUATION) for w in set(words)])
    out.discard(b"")
    return out


def document_frequency(docs: DataFrame) -> DataFrame:
    """(term, df): in how many documents each term is."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                               ["term", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                seen.update(terms_of(text.as_py()))
                if len(seen) > FLUSH_TERMS:
                    yield flush()
        yield flush()

    return (docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(count, "term binary, n long")
            .groupBy("term").agg(F.sum("n").alias("df")))


def lexicon(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> list[bytes]:
    """The terms of the band, sorted; their number is bounded by the band."""
    n = docs.count()
    band = document_frequency(docs).where(F.col("df").between(max(2.0, min_share * n), max(2.0, max_share * n)))
    return sorted(bytes(r["term"]) for r in band.select("term").collect())


class Fingerprinter:
    """Hashes of a set of terms, one for each sub-lexicon."""

    def __init__(self, terms: list[bytes]):
        from xxhash import xxh64_intdigest
        self.number = {t: i for i, t in enumerate(terms)}
        self.key = np.array([xxh64_intdigest(t, 1) for t in terms], np.uint64)
        self.inside = np.zeros((len(terms), len(DENSITIES)), bool)
        for i, share in enumerate(DENSITIES):
            draw = np.array([xxh64_intdigest(t, 100 + i) for t in terms], np.uint64)
            self.inside[:, i] = draw < np.uint64(int(share * 2 ** 64))

    def hashes(self, text: str) -> np.ndarray:
        """32 bits for each sub-lexicon, 0 where the text has no term of it."""
        own = np.array(sorted(self.number[t] for t in terms_of(text) & self.number.keys()), np.int64)
        # a hash of the sorted distinct terms: the sum of their keys, mixed
        total = np.where(self.inside[own], self.key[own][:, None], np.uint64(0)).sum(0, dtype=np.uint64)
        mixed = (total ^ total >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
        mixed = (mixed ^ mixed >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(32)
        return np.where(self.inside[own].any(0), mixed | np.uint64(1), np.uint64(0)).astype(np.uint32)


def to_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    either = (a != 0) | (b != 0)
    return float((a[either] == b[either]).mean()) if either.any() else 1.0


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the following."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, **band) -> DataFrame:
    """doc_id and fingerprint of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(Fingerprinter(lexicon(docs, **band)))  # bounded by the band

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = shared.value
        for batch in batches:
            made = [to_text(maker.hashes(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "doc_id long, fingerprint string")


def range_cuts(docs: DataFrame, ranges: int) -> np.ndarray:
    """Ascending ids that cut the documents into about equal ranges."""
    share = [i / ranges for i in range(1, ranges)]
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), share, max(10_000, 10 * ranges))).first()[0] if share else None
    return np.unique(np.array(found or [], np.int64))  # at most `ranges` numbers


def ranges_of(ids: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The range of each id; 0 holds the largest."""
    return len(cuts) - np.searchsorted(cuts, ids, side="left")


def range_heads(docs: DataFrame, cuts: np.ndarray) -> dict[int, int]:
    """The largest id of each range that has rows; one number a range."""
    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, int] = {}
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for at in np.unique(own := ranges_of(ids, cuts)):
                most[int(at)] = max(most.get(int(at), NO_ID), int(ids[own == at].max()))
        yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int64()), pa.array(list(most.values()), pa.int64())], ["range", "head"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).mapInArrow(heads, "range long, head long")
    return {r["range"]: r["head"] for r in rows.groupBy("range").agg(F.max("head").alias("head")).collect()}


def in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """(range, tail, doc_id, packed): the rows with their range of doc_id
    (0 holds the largest ids), and again, as the tail of the range before,
    the first row of every range (of the first: as the tail of the last)."""
    from zstandard import ZstdCompressor

    cuts = range_cuts(docs, ranges)
    heads = range_heads(docs, cuts)
    full = sorted(heads)
    before = {heads[r]: full[i - 1] for i, r in enumerate(full)}  # head: the range that it follows
    names = ["range", "tail", "doc_id", "packed"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = ZstdCompressor(level=3).compress
        for batch in batches:
            ids = batch.column(0).to_pylist()
            keys = [NO_ID if i is None else i for i in ids]
            own = ranges_of(np.array(keys, np.int64), cuts).tolist()
            packed = [zip_((t.as_py() or "").encode()) for t in batch.column(1)]
            rows = [(r, False, i, p) for r, i, p in zip(own, ids, packed)]
            rows += [(before[k], True, i, p) for k, i, p in zip(keys, ids, packed) if k in before]
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows
                                             else [pa.array([], t) for t in kinds], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        pack, "range long, tail boolean, doc_id long, packed binary")


EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def edited_fingerprints(docs: DataFrame, **band) -> DataFrame:
    """One row per document with the columns of ``EDITED``."""
    from zstandard import ZstdDecompressor

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Fingerprinter(lexicon(docs, **band)))  # bounded by the band
    names = [c.split()[0] for c in EDITED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, unzip, done = shared.value, ZstdDecompressor().decompress, []

        def emit(doc_id, text, own, after, theirs):
            new = edited(text, after)
            changed = maker.hashes(new)
            done.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), to_text(own), to_text(changed),
                         likeness(own, changed), likeness(own, theirs)))

        held = None  # the document whose follower is awaited, with its range
        for batch in batches:
            for at, tail, doc_id, packed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and held[0] != at:
                    held = None
                if tail and held is None:
                    continue
                text = unzip(packed).decode()
                own = maker.hashes(text)
                if held:
                    emit(*held[1:], text, own)
                held = None if tail else (at, doc_id, text, own)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names)
                done.clear()

    n = shuffle_partitions(spark)
    dealt = in_ranges(docs, 4 * n).repartition(n, "range")
    order = [F.col("range"), F.col("tail"), F.col("doc_id").desc_nulls_last(), F.col("packed")]
    return dealt.sortWithinPartitions(*order).mapInArrow(compare, EDITED)


def op8_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op8_imatch_fingerprints": op8_imatch_fingerprints}
ORACLE_SQL: dict[str, str] = {}
