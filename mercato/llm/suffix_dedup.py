"""Operator 13, substring dedup with a blockwise difference-cover suffix sort.

Texts are UTF-8 bytes. A window is ``WINDOW`` consecutive bytes of one
document; a byte goes if it is in a window whose bytes also start in a
document with a smaller doc_id.

1. Candidates. Of every window, the gram (``GRAM`` bytes) with the smallest
   hash is its anchor, so equal windows have equal anchors wherever they
   stand. Blocks of documents send their distinct anchors to buckets; an
   anchor of one document only needs no sorting.
2. Suffixes. Consecutive windows of one anchor and the text that they span
   are a segment; equal segments of a block are one with its smallest
   doc_id. A segment goes to the bucket of its anchor, so equal windows meet.
   A bucket is a text whose window starts are sorted as suffixes:
   - the ranks of the suffixes at a difference cover (5 of each 16 places)
     are computed first, by prefix doubling to 64 bytes;
   - the window starts are dealt out by their first bytes into blocks of
     bounded size, and one block at a time is sorted by its first 16 bytes;
   - longer ties are resolved by the cover ranks: for any two places some
     shift below 16 takes both to the cover. Segments are laid out with
     their anchors at multiples of 16, so equal windows have one common
     shift, and only ties of places that differ modulo 16 need the rank of
     each against each class.
   Neighbours in that order whose 50 bytes are equal share the smallest
   doc_id of their group.
3. Removal. Each block marks the windows that start in a smaller document.

A task holds one block or one bucket. An anchor of very many documents
(``HOT``) would make one long bucket: its windows are segments of their own
then, dealt out by the hash of their whole 50 bytes, so that only equal
windows, which are one per block, stay together.

Cases: a null text has no bytes; shorter texts than a window lose nothing; a
very long text is a block of its own, searched in steps; rows that repeat a
doc_id never remove each other's bytes; a null doc_id counts as larger than
any other; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import (ANSWER, BLOCK_BYTES, LAST_ID, Texts, answer_batch, answer_bytes, blocks, bucket_count, bucket_map,
                     bucket_slices, with_answers)
from .common import table

WINDOW, GRAM = 50, 24
BUCKET_BYTES = 8 << 20   # of text, for each bucket of anchors
HOT = 100_000            # documents that make an anchor's windows segments of their own
COVER, PERIOD = (0, 1, 2, 5, 8), 16  # every difference modulo 16 is one of two of these
SORT_BLOCK = 1 << 20     # suffixes that are sorted at a time
KEY_BITS = 48            # of an anchor
_STEP_BITS = 20
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9)]
_NONE = np.uint64(2 ** 64 - 1)


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one big-endian number."""
    n = len(data) - 7
    if n <= 0:
        return np.zeros(0, np.uint64)
    return np.ndarray((n,), ">u8", np.ascontiguousarray(data), 0, (1,)).astype(np.uint64)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from every place on (8 bytes at least)."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = words_at(data)
    h = np.zeros(n, np.uint64)
    places = list(range(0, gram - 7, 8)) + ([gram - 8] if gram % 8 else [])
    for k, at in enumerate(places):
        h += words[at:at + n] * _MIX[k % 3]
        h ^= h >> np.uint64(31)
        h *= _MIX[3]
    return h ^ h >> np.uint64(32)


class Runs:
    """The runs of windows of a block that have one anchor occurrence: first
    and last window start, place and key of the anchor, number of the text."""

    def __init__(self, texts: Texts, window: int, gram: int):
        data, width = texts.data, window - gram + 1
        lo, hi, at, key = [], [], [], []
        step = (1 << _STEP_BITS) - window
        for c in range(0, max(0, len(data) - window + 1), step):
            part = data[c:c + step + window - 1]
            h = gram_hashes(part, gram)
            least = h >> np.uint64(_STEP_BITS) << np.uint64(_STEP_BITS) | np.arange(len(h), dtype=np.uint64)
            n, span = len(part) - window + 1, 1
            while span * 2 <= width:  # the smallest of 2, 4, 8 ... places
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            least = np.minimum(least[:n], least[width - span:width - span + n])
            # windows that would cross the end of a text have none
            first, last = np.searchsorted(texts.starts, [c, c + n], "right")
            for end in texts.starts[max(1, first):last + 1].tolist() + [int(texts.starts[min(last, texts.n)])]:
                least[max(0, end - window + 1 - c):max(0, min(n, end - c))] = _NONE
            cuts = np.r_[0, np.flatnonzero(least[1:] != least[:-1]) + 1, n]
            own = least[cuts[:-1]]
            real = own != _NONE
            place = (own & np.uint64((1 << _STEP_BITS) - 1)).astype(np.int64)[real]
            lo.append(cuts[:-1][real] + c)
            hi.append(cuts[1:][real] - 1 + c)
            at.append(place + c)
            # the anchor's hash is a smallest one: mixed again, it is spread over all buckets
            key.append((h[place] * _MIX[0] ^ h[place] >> np.uint64(17)) * _MIX[1] >> np.uint64(64 - KEY_BITS))
        self.lo, self.hi, self.at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lo, hi, at))
        self.key = np.concatenate(key) if key else np.zeros(0, np.uint64)
        self.text = np.searchsorted(texts.starts, self.lo, "right") - 1

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys, ascending, and how many texts have each."""
        order = np.lexsort((self.text, self.key))
        key, text = self.key[order], self.text[order]
        new_key = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        new = new_key | np.r_[True, text[1:] != text[:-1]] if len(key) else new_key
        starts = np.flatnonzero(new_key)
        return key[starts], np.add.reduceat(new.astype(np.int64), starts) if len(starts) else starts


def anchor_rows(held: DataFrame, window: int, gram: int, buckets: int) -> DataFrame:
    """(bucket, block, keys, counts): the distinct anchors of every block."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, counts = Runs(Texts(payload.as_buffer()), window, gram).distinct()
                bucket, cuts = bucket_slices(keys, KEY_BITS, buckets)
                packed = keys.view(np.uint8).reshape(-1, 8)[:, :6]
                few = np.minimum(counts, 2 ** 16 - 1).astype(np.uint16)
                spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket), pa.array([block] * len(bucket), pa.int64()),
                    pa.array([packed[a:b].tobytes() for a, b in spans], pa.binary()),
                    pa.array([few[a:b].tobytes() for a, b in spans], pa.binary())], ["bucket", "block", "keys", "counts"])

    return held.select("block", "payload").mapInArrow(rows, "bucket long, block long, keys binary, counts binary")


def repeated_anchors(rows_in: DataFrame, hot: int) -> DataFrame:
    """For each anchor that a block asked about: 0 if one document has it, 1
    if more have, 2 if ``hot`` or more."""
    def work(found: list[dict]) -> pa.RecordBatch:
        sizes = [len(r["keys"]) // 6 for r in found]
        keys = np.zeros((sum(sizes), 8), np.uint8)
        keys[:, :6] = np.frombuffer(b"".join(r["keys"] for r in found), np.uint8).reshape(-1, 6)
        known, number = np.unique(keys.view(np.uint64).ravel(), return_inverse=True)
        total = np.bincount(number, np.frombuffer(b"".join(r["counts"] for r in found), np.uint16), len(known))
        code = ((total > 1).astype(np.uint8) + (total >= hot))[number]
        ends = np.cumsum(sizes)
        return answer_batch([(r["bucket"], r["block"], code[e - n:e].tobytes()) for r, n, e in zip(found, sizes, ends)])

    return bucket_map(rows_in, work, ANSWER)


class Segments:
    """The distinct segments of a block, in the order in which they go to the
    buckets, and the windows that have them."""

    def __init__(self, texts: Texts, codes: bytes, window: int, gram: int):
        runs = Runs(texts, window, gram)
        keys, _ = runs.distinct()
        code = np.frombuffer(codes, np.uint8)[np.searchsorted(keys, runs.key)] if len(keys) else np.zeros(0, np.uint8)
        plain, hot = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
        lo, hi, at, text, key = (x[plain] for x in (runs.lo, runs.hi, runs.at, runs.text, runs.key))
        if len(hot):  # each window of a hot anchor by itself
            sizes = runs.hi[hot] - runs.lo[hot] + 1
            own = np.repeat(runs.lo[hot] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
            held = texts.data.tobytes()
            own_key = np.fromiter((int.from_bytes(hashlib.blake2b(held[p:p + window], digest_size=6).digest()) for p in own.tolist()),
                                  np.uint64, len(own))
            lo, hi, at = np.r_[lo, own], np.r_[hi, own], np.r_[at, own]
            text, key = np.r_[text, np.repeat(runs.text[hot], sizes)], np.r_[key, own_key]
        data = texts.data.tobytes()
        ids = texts.keys()[text]
        number: dict[bytes, int] = {}
        self.of = np.fromiter((number.setdefault(data[a:b], len(number)) for a, b in zip(lo.tolist(), (hi + window).tolist())),
                              np.int64, len(lo))
        self.lo, self.hi, self.ids = lo, hi, ids
        n = len(number)
        first = np.full(n, len(lo), np.int64)
        np.minimum.at(first, self.of, np.arange(len(lo)))
        least = np.full(n, LAST_ID, np.int64)
        np.minimum.at(least, self.of, ids)
        order = np.argsort(key[first], kind="stable")
        self.texts = list(number)
        self.order, self.key, self.least, self.anchor = order, key[first][order], least[order], (at - lo)[first][order]


def segment_rows(asked: DataFrame, window: int, gram: int, buckets: int) -> DataFrame:
    """(bucket, block, texts, sizes, anchors, ids): the candidate segments."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload, codes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                own = Segments(Texts(payload.as_buffer()), answer_bytes(codes), window, gram)
                bucket, cuts = bucket_slices(own.key, KEY_BITS, buckets)
                spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                texts = [own.texts[i] for i in own.order.tolist()]
                sizes = np.fromiter(map(len, texts), np.uint32, len(texts))
                cols = [[b"".join(texts[a:b]) for a, b in spans]]
                cols += [[x[a:b].tobytes() for a, b in spans] for x in (sizes, own.anchor.astype(np.uint32), own.least)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array([block] * len(bucket), pa.int64())]
                                                 + [pa.array(c, pa.binary()) for c in cols],
                                                 ["bucket", "block", "texts", "sizes", "anchors", "ids"])

    return asked.select("block", "payload", "codes").mapInArrow(
        rows, "bucket long, block long, texts binary, sizes binary, anchors binary, ids binary")


def shifts() -> np.ndarray:
    """For two places modulo ``PERIOD``: the shift that takes both to the
    difference cover."""
    inside = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    out = np.array([[next((k for k in range(PERIOD) if inside[p + k] and inside[q + k]), -1)
                     for q in range(PERIOD)] for p in range(PERIOD)])
    assert (out >= 0).all()
    return out


def pair_order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The order by ``high``, ties by ``low``; only ties look at ``low``."""
    order = np.argsort(high)
    by_high = high[order]
    new = np.r_[True, by_high[1:] != by_high[:-1], True] if len(order) else np.zeros(1, bool)
    tied = np.flatnonzero(~(new[:-1] & new[1:]))
    if len(tied):
        group = np.cumsum(new[:-1])[tied]
        mine = order[tied]
        second = low[mine]
        by_low = np.argsort(second)
        rank = np.empty(len(mine), np.int64)
        rank[by_low] = np.cumsum(np.r_[False, np.diff(second[by_low]) != 0])
        order[tied] = mine[np.argsort(group * np.int64(len(mine) + 1) + rank)]
    return order


class CoverRanks:
    """Ranks of the suffixes at the difference cover, by ``depth`` bytes."""

    def __init__(self, text: np.ndarray, depth: int):
        self.per = len(COVER)
        self.index = np.full(PERIOD, -1)
        self.index[list(COVER)] = np.arange(self.per)
        places = (np.arange(len(text) // PERIOD)[:, None] * PERIOD + np.array(COVER)).ravel()
        words = np.r_[text, np.zeros(3 * PERIOD, np.uint8)]
        words = np.ndarray((len(text) + PERIOD,), ">u8", words, 0, (1,))
        high, low = words[places].astype(np.uint64), words[places + 8].astype(np.uint64)
        order = pair_order(high, low)
        self.rank = self.numbered(order, (high[order], low[order]))
        reach = PERIOD
        while reach < depth:  # the suffix that starts where this rank's bytes end is in the cover too
            after = np.r_[self.rank[self.per * reach // PERIOD:], np.zeros(self.per * reach // PERIOD, np.int64)][:len(places)]
            both = self.rank * np.int64(len(places) + 1) + after
            order = np.argsort(both)
            self.rank = self.numbered(order, (both[order],))
            reach *= 2

    @staticmethod
    def numbered(order: np.ndarray, sorted_keys: tuple) -> np.ndarray:
        rank = np.zeros(len(order), np.int64)
        if len(order):
            new = np.zeros(len(order), bool)
            for k in sorted_keys:
                new[1:] |= k[1:] != k[:-1]
            rank[order] = np.cumsum(new) + 1
        return rank

    def at(self, places: np.ndarray) -> np.ndarray:
        return self.rank[places // PERIOD * self.per + self.index[places % PERIOD]]


def sorted_block(places: np.ndarray, high: np.ndarray, low: np.ndarray, ranks: CoverRanks, shift: np.ndarray) -> np.ndarray:
    """The places in the order of their suffixes: by 16 bytes, ties by the
    cover ranks."""
    order = pair_order(high, low)
    places, high, low = places[order], high[order], low[order]
    group = np.cumsum(np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])]) - 1
    size = np.bincount(group)
    tied = size[group] > 1
    at, of = places[tied], group[tied]
    if not len(at):
        return places
    cls = at % PERIOD
    firsts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    counts = np.diff(np.r_[firsts, len(of)])
    mixed = np.repeat(np.maximum.reduceat(cls, firsts) != np.minimum.reduceat(cls, firsts), counts)
    before = np.zeros(len(at), np.int64)
    # one class: a common shift, so the ranks there are the order
    one = ~mixed
    before[one] = ranks.at(at[one] + shift[cls[one], cls[one]])
    # several: how many of each class stand before
    many = np.flatnonzero(mixed)
    if len(many):
        scale = np.int64(len(ranks.rank) + 2)
        members = [many[cls[many] == c] for c in range(PERIOD)]
        for p in range(PERIOD):
            for q in range(PERIOD):
                if len(members[p]) and len(members[q]):
                    k = shift[p, q]
                    theirs = np.sort(of[members[q]] * scale + ranks.at(at[members[q]] + k))
                    mine = of[members[p]]
                    found = np.searchsorted(theirs, mine * scale + ranks.at(at[members[p]] + k))
                    before[members[p]] += found - np.searchsorted(theirs, mine * scale)
    places[tied] = at[np.argsort(of * np.int64(before.max() + 1) + before)]
    return places


def smallest_ids(texts: bytes, sizes: np.ndarray, anchors: np.ndarray, ids: np.ndarray, window: int,
                 sort_block: int = SORT_BLOCK) -> np.ndarray:
    """For every window of the segments, in order, the smallest id of the
    windows with the same bytes."""
    # the text: every segment with its anchor at a multiple of the period
    sizes, anchors = sizes.astype(np.int64), anchors.astype(np.int64)
    lead = -anchors % PERIOD
    room = -(-(lead + sizes) // PERIOD) * PERIOD
    start = np.cumsum(room) - room + lead
    text = np.zeros(int(room.sum()), np.uint8)
    inside = np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    text[inside] = np.frombuffer(texts, np.uint8)
    del inside
    n = sizes - window + 1
    places = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    owner = np.repeat(ids, n)
    depth = PERIOD
    while depth < window:
        depth *= 2
    ranks, shift = CoverRanks(text, depth), shifts()
    held = np.r_[text, np.zeros(window + 8, np.uint8)]
    words = np.ndarray((len(held) - 7,), ">u8", held, 0, (1,))
    number = np.zeros(len(text), np.int32)  # the window that starts at a place
    number[places] = np.arange(len(places))
    first = words[places].astype(np.uint64)
    # blocks of suffixes with neighbouring first bytes
    parts = -(-len(places) // sort_block)
    pivots = np.unique(np.sort(first[::max(1, len(first) // (16 * parts))])[8::16]) if parts > 1 else np.zeros(0, np.uint64)
    part = np.searchsorted(pivots, first, "right")
    least = np.empty(len(places), np.int64)
    offsets = sorted({*range(0, window - 7, 8), window - 8})
    for p in range(len(pivots) + 1):
        mine = np.flatnonzero(part == p)
        if not len(mine):
            continue
        low = words[places[mine] + 8].astype(np.uint64)
        order = sorted_block(places[mine], first[mine], low, ranks, shift)
        new = np.zeros(len(order), bool)
        for off in offsets:  # neighbours with the same bytes are one group
            w = words[order + off]
            new[1:] |= w[1:] != w[:-1]
        new[0] = True
        at = number[order]
        starts = np.flatnonzero(new)
        least[at] = np.repeat(np.minimum.reduceat(owner[at], starts), np.diff(np.r_[starts, len(at)]))
    return least


def sorted_segments(rows_in: DataFrame, window: int, sort_block: int) -> DataFrame:
    """For every segment that a block sent, the smallest id of each of its
    windows, as runs: how many windows, and the id."""
    def work(found: list[dict]) -> pa.RecordBatch:
        join = lambda name, kind: np.frombuffer(b"".join(r[name] for r in found), kind)
        # segments that several blocks sent are sorted once
        sizes, texts, number = join("sizes", np.uint32), b"".join(r["texts"] for r in found), {}
        ends = np.cumsum(sizes, dtype=np.int64).tolist()
        of = np.fromiter((number.setdefault(texts[a:b], len(number)) for a, b in zip([0, *ends], ends)), np.int64, len(ends))
        del texts
        ids, anchors = np.full(len(number), LAST_ID, np.int64), np.zeros(len(number), np.uint32)
        np.minimum.at(ids, of, join("ids", np.int64))
        anchors[of] = join("anchors", np.uint32)
        known = np.fromiter(map(len, number), np.int64, len(number))
        least = smallest_ids(b"".join(number), known, anchors, ids, window, sort_block)
        known -= window - 1
        start = np.cumsum(known) - known
        out, at = [], 0
        for r in found:
            k = len(r["sizes"]) // 4
            mine = of[at:at + k]
            n = known[mine]
            own = least[np.repeat(start[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            cuts = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1, len(own)]
            answer = np.empty(len(cuts) - 1, [("n", "<u4"), ("id", "<i8")])
            answer["n"], answer["id"] = np.diff(cuts), own[cuts[:-1]]
            out.append((r["bucket"], r["block"], answer.tobytes()))
            at += k
        return answer_batch(out)

    return bucket_map(rows_in, work, ANSWER)


def removed(texts: Texts, codes: bytes, answers: bytes, window: int, gram: int) -> np.ndarray:
    """Which bytes of the block go."""
    change = np.zeros(len(texts.data) + 1, np.int32)
    own = Segments(texts, codes, window, gram)
    if len(own.lo):
        runs = np.frombuffer(answers, [("n", "<u4"), ("id", "<i8")])
        least = np.repeat(runs["id"], runs["n"])
        n = np.fromiter((len(t) - window + 1 for t in own.texts), np.int64, len(own.texts))
        start = np.empty(len(n), np.int64)  # of each segment's windows among the answers
        start[own.order] = np.cumsum(n[own.order]) - n[own.order]
        sizes = own.hi - own.lo + 1
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        gone = least[np.repeat(start[own.of], sizes) + inside] < np.repeat(own.ids, sizes)
        places = (np.repeat(own.lo, sizes) + inside)[gone]
        change[places] += 1
        change[places + window] -= 1
    return np.cumsum(change[:-1]) > 0


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT,
                   block_bytes: int = BLOCK_BYTES, sort_block: int = SORT_BLOCK, keep_bytes: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256
    (and the kept bytes with ``keep_bytes``; they need not be UTF-8)."""
    held = blocks(docs, block_bytes)
    buckets = bucket_count(held, bucket_bytes)
    codes = repeated_anchors(anchor_rows(held, window, gram, buckets), hot)
    asked = with_answers(held.drop("n_bytes"), codes=codes)
    least = sorted_segments(segment_rows(asked, window, gram, buckets), window, sort_block)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, code, answer in zip(*(batch.column(i) for i in range(3))):
                texts = Texts(payload.as_buffer())
                gone = removed(texts, answer_bytes(code), answer_bytes(answer), window, gram)
                out = []
                for a, b in zip(texts.starts[:-1].tolist(), texts.starts[1:].tolist()):
                    mask = gone[a:b]
                    kept = texts.data[a:b][~mask].tobytes()
                    spans = int(mask[0] if b > a else 0) + int(np.count_nonzero(mask[1:] & ~mask[:-1]))
                    out.append((b - a, int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()) + ((kept,) if keep_bytes else ()))
                kinds = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * keep_bytes
                yield pa.RecordBatch.from_arrays([texts.ids] + [pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_bytes)

    return (with_answers(asked, least=least).select("payload", "codes", "least")
            .mapInArrow(rows, REMOVED + (", kept binary" if keep_bytes else "")))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op13_suffix_dedup": op13_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
