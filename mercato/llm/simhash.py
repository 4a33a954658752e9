"""Operator 5, SimHash near-dedup over a byte-position inverted index.

A fingerprint is eight bytes. Two fingerprints that differ in at most ``d``
bits differ in at most ``d`` bytes, so they share at least ``8 - d`` bytes at
the same positions: that is the guaranteed minimum of matches. Posting lists
of single bytes would hold 1/256 of all documents each, so the index is
kept by *sets* of ``8 - d`` positions: a fingerprint is posted under each of
these sets with the bytes it has there (70 sets for d = 4). Two
fingerprints meet in a posting list exactly if their tally of shared
positional bytes reaches the minimum; those that meet are verified by their
differing bits. Distinct fingerprints are indexed once, however many
documents have them.

No list is expanded to pairs: a list is searched breadth first and gives a
star per component. Lists of more than ``max_list`` fingerprints (large
groups of near copies) are not searched at all; their members are posted
again under every value within ``ceil(d / 2)`` bits instead. Two
fingerprints at ``d`` bits or fewer share such a midpoint, and only the
fingerprints around it (2081 values at most for d = 4) are in its list, so
this is exact and its work grows with the members, not with their pairs.

Components of the links come from alternating large-star / small-star
rounds over stored tables; nothing but two numbers a round reaches the
driver.

Cases: null, empty and blank texts have fingerprint zero and are linked like
any other; texts of fewer words than a shingle are one shingle; a text is
read in blocks, whatever its length; rows that repeat a doc_id each get a
row; a null doc_id is reachable but never the smallest unless all are null;
an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import first_row, keyed, own_name, same_row, shuffle_partitions, sorted_groups, stored, table, word_blocks

SHINGLE, MAX_BITS, SEED = 4, 4, 42
MAX_LIST = 8192


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text: bit set if set in over half the hashes
    of its word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    ones, total, kept = np.zeros(64, np.int64), 0, []
    for words in word_blocks((text or "").encode().lower()):
        words = kept + words
        if len(words) >= shingle:
            joined = b" ".join(words)
            lens = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(lens + 1) - 1
            starts = (ends - lens)[:len(words) - shingle + 1].tolist()
            hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1:].tolist())]
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.int64)
            total += len(hashes)
        kept = words[max(0, len(words) - shingle + 1):]
    if not total and kept:
        return xxh64_intdigest(b" ".join(kept), seed)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, own: str | None = None) -> DataFrame:
    """doc_id (and ``own``) and fp (the fingerprint's 64 bits as a signed number)."""
    keys = ["doc_id"] + [own] * bool(own)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle, seed) for t in batch.column(len(keys))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keys)], pa.array(np.array(fps, np.uint64).view(np.int64))], [*keys, "fp"])

    return docs.select(*[F.col(k).cast("long").alias(k) for k in keys], "text").mapInArrow(
        of, "".join(f"{k} long, " for k in keys) + "fp long")


def components_of(fps: np.ndarray, max_bits: int) -> Iterator[np.ndarray]:
    """Positions of each component of two or more fingerprints, breadth
    first: what is found is not compared again."""
    left = np.arange(len(fps))
    while left.size > 1:
        found, left = [left[:1]], left[1:]
        front = fps[found[0]]
        while front.size and left.size:
            near = np.zeros(left.size, bool)
            for at in range(0, front.size, 128):
                near |= (np.bitwise_count(fps[left][:, None] ^ front[None, at:at + 128]) <= max_bits).any(1)
            found.append(left[near])
            front, left = fps[left[near]], left[~near]
        if len(found[-1]) or len(found) > 2:
            yield np.concatenate(found)


def linked(posted: DataFrame, max_bits: int) -> DataFrame:
    """Links (a > b) that join the components of every posting list."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, sizes, fps in sorted_groups(batches, "key", "fp"):
            a, b = [], []
            two = starts[sizes == 2]
            x, y = fps[two], fps[two + 1]
            near = np.bitwise_count((x ^ y).view(np.uint64)) <= max_bits
            a.append(np.maximum(x, y)[near])
            b.append(np.minimum(x, y)[near])
            for start, n in zip(starts[sizes > 2], sizes[sizes > 2]):
                own = fps[start:start + n]
                for found in components_of(own.view(np.uint64), max_bits):
                    least = own[found].min()
                    rest = own[found][own[found] != least]
                    a.append(rest)
                    b.append(np.full(len(rest), least))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    n = shuffle_partitions(posted.sparkSession)
    return (posted.repartition(n, "key").sortWithinPartitions("key").mapInArrow(search, "a long, b long")
            .where("a <> b").distinct())


def post(fps: DataFrame, max_bits: int) -> DataFrame:
    """(key, fp): each fingerprint under every set of ``8 - max_bits`` byte
    positions, with its bytes there."""
    sets = list(combinations(range(8), 8 - max_bits))
    masks = [sum(0xFF << 8 * p for p in s) for s in sets]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            fp = np.asarray(batch.column(0))
            for at in range(0, len(fp), 2000):
                part = fp[at:at + 2000].view(np.uint64)
                if max_bits >= 4:  # the set's number and at most four bytes fit into a key as they are
                    key = np.zeros((len(masks), len(part)), np.uint64)
                    for i, s in enumerate(sets):
                        key[i] = i
                        for p in s:
                            key[i] = key[i] << np.uint64(8) | part >> np.uint64(8 * p) & np.uint64(0xFF)
                else:  # a hash of both; what meets by chance is verified all the same
                    key = np.stack([((part & np.uint64(m)) ^ np.uint64(i * 0x2545F491)) * mix for i, m in enumerate(masks)])
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)),
                                                  pa.array(np.tile(fp[at:at + 2000], len(masks)))], ["key", "fp"])

    return fps.select("fp").mapInArrow(keys, "key long, fp long")


def post_midpoints(fps: DataFrame, radius: int) -> DataFrame:
    """(key, fp): each fingerprint under every value within ``radius`` bits."""
    flips = np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(64), r)], np.uint64)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0))
            for at in range(0, len(fp), 50):
                part = fp[at:at + 50].view(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((part[:, None] ^ flips[None, :]).reshape(-1).view(np.int64)),
                     pa.array(np.repeat(fp[at:at + 50], len(flips)))], ["key", "fp"])

    return fps.select("fp").mapInArrow(keys, "key long, fp long")


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, max_list: int = MAX_LIST) -> DataFrame:
    """Links between distinct fingerprints whose components are those of all
    pairs at ``max_bits`` or fewer differing bits."""
    posted = post(fps, max_bits)
    long = stored(posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_list)
                  .select("key"), "long-lists")
    links = linked(posted.join(long, "key", "left_anti"), max_bits)
    dense = stored(posted.join(long, "key", "left_semi").select("fp").distinct(), "dense")
    if not dense.isEmpty():
        links = links.unionByName(linked(post_midpoints(dense, -(-max_bits // 2)), max_bits)).distinct()
    return links


def connected(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` but the roots themselves;
    the root is the smallest node of the component."""
    edges, state = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                          .where("a <> b").distinct(), "links"), None
    for _ in range(max_rounds):
        r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(r) == state:
            break
        state = tuple(r)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        edges = stored(small, "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_components(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED,
                    max_list: int = MAX_LIST) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    rows = stored(fingerprints(docs, shingle, seed), "fingerprints")
    return with_least(rows, F.min("doc_id"), max_bits, max_list).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least").alias("component_id"))


def with_least(rows: DataFrame, least: Column, max_bits: int, max_list: int) -> DataFrame:
    """The rows with the ``least`` (an aggregate of their keys) of their component."""
    fps = stored(rows.groupBy("fp").agg(least.alias("least")), "distinct")
    roots = connected(near_links(fps, max_bits, max_list))
    fps = (fps.join(roots, fps["fp"] == roots["node"], "left")
           .select("fp", F.col("least").alias("of_fp"), F.coalesce("root", "fp").alias("root")))
    smallest = fps.groupBy("root").agg(F.min("of_fp").alias("least"))
    return rows.join(fps.join(smallest, "root").select("fp", "least"), "fp")


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED,
               max_list: int = MAX_LIST) -> DataFrame:
    """The row of ``docs`` with the smallest doc_id of each component, one
    also where its ids are null or repeated."""
    own = own_name()
    docs = keyed(docs, own)
    rows = stored(fingerprints(docs, shingle, seed, own), "fingerprints")
    gone = (with_least(rows, first_row(own), max_bits, max_list)
            .where(~(F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & F.col(own).eqNullSafe(F.col("least.own"))))
            .select(F.col("doc_id").alias("_gone_id"), F.col(own).alias("_gone_own")))
    return docs.join(gone, same_row(docs, gone, own, "_gone_id", "_gone_own"), "left_anti").drop(own)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


QUERIES = {"op5_simhash_near_dedup": op5_simhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
