"""Operator 11, cross-tokenizer alignment with minimal perfect hashing.

Two tokenizers, A (byte-level BPE) and B (pieces with byte fallback), cut a
text into tokens of bytes. Places where tokens of both end cut it into
groups; an A and a B token whose byte ranges overlap are linked, and a pair
of ids counts as often as the whole corpus links it.

1. Blocks of documents are tokenized and aligned. Neither tokenizer joins anything across a
   space that follows a visible character, so a text is aligned segment by
   segment, each of a block's segments once. Every end of a token
   closes one link: the A and the B token that hold the byte before it.
2. The distinct pairs of a block go to buckets by their B id, so a pair is
   one entry per block however often it stands there.
3. The distinct pairs of a bucket, united in a tree, get a minimal perfect
   hash (levels of bits for keys without a collision, places by rank) and the
   list of keys at their places, against which every lookup is verified.
4. Blocks' counts become dense vectors indexed by that hash, added up in a
   tree of ``FAN`` vectors a node.
5. Each block's pairs are looked up in the sums; with these answers the
   documents of the block are aligned again, from their stored tokens, and
   their links looked up.

A's ids stand in the order of its merges, so they are ranks and the faster
``tiktoken`` gives the same ids; that is checked when the file is opened.

A task holds one block, or of one bucket ``FAN`` blocks' entries. A bucket
has all pairs of a B id, at most as many as A has ids.

Cases: a null or empty text and a text that a tokenizer does not give back
byte by byte (A or B joined differ from the space and the text) have no
tokens: zeros and an empty ``groups_sha256``; special tokens' strings are
plain text; a very long text is a block of its own, cut up in steps; rows
that repeat a doc_id, or have none, are documents of their own; an empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import (ANSWER, BLOCK_BYTES, Texts, answer_batch, answer_bytes, bucket_map, bucket_slices, dealt, pack_batch,
                     texts_of, unpack_batch, with_answers)
from .common import stored, table

BUCKETS = 128              # of pairs; their number is bounded by the vocabularies, not by the corpus
FAN = 64                   # blocks or vectors that a node of the tree adds up
_TOGETHER = 1000           # segments that are encoded as one text
_STEP = 1 << 20            # characters that are cut up at a time
_SPREAD = 2654435769       # odd, so that multiplying by it permutes 32-bit numbers
_CUT = re.compile(r"(?<=\S)(?= )")
_SPACES = re.compile(r"\s ")


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: the
    visible Latin-1 characters for themselves, the others counted from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers with the bytes of their ids, opened once per worker."""

    _open: dict[tuple, Tokenizers] = {}

    @classmethod
    def get(cls, paths: tuple[str, str]) -> Tokenizers:
        if paths not in cls._open:
            cls._open[paths] = cls(*paths)
        return cls._open[paths]

    def __init__(self, a_path: str, b_path: str):
        import json

        from sentencepiece import SentencePieceProcessor
        with open(a_path, encoding="utf-8") as f:
            file = json.load(f)
        self.b = SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        special = {t["content"] for t in file["added_tokens"]}
        vocabulary = file["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            if entry not in special:
                self.a_bytes[i] = bytes(letters[c] for c in entry)
        self.a = self.a_encoder(a_path, file, special)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        # a token as text, followed by what stands after it in a group
        self.a_text = [np.array([f"{i}{c}" for i in range(len(x))], object) for x, c in ((self.a_bytes, ","), (self.a_bytes, "|"))]
        self.b_text = [np.array([f"{i}{c}" for i in range(len(x))], object) for x, c in ((self.b_bytes, ","), (self.b_bytes, ";"))]
        # B adds no space to an empty text: a last space by itself is this piece
        self.space = [self.b.piece_to_id("▁")]

    def a_encoder(self, path: str, file: dict, special: set[str]):
        """A function from texts to lists of A's ids, special tokens' strings
        as plain text."""
        vocabulary, merges = file["model"]["vocab"], file["model"]["merges"]
        joined = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in merges]
        splitter = file["pre_tokenizer"]
        if ([vocabulary[m] for m in joined] == list(range(256, 256 + len(joined))) and not file.get("normalizer")
                and splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space")):
            import public_tokenizers
            import tiktoken
            ranks = {self.a_bytes[i]: i for entry, i in vocabulary.items() if entry not in special}
            fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            return lambda texts: [fast.encode_ordinary(t) for t in texts]
        from tokenizers import Tokenizer
        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True
        return lambda texts: [own.encode(t, add_special_tokens=False).ids for t in texts]

    def bytes_of(self, a: list[int], b: list[int]) -> tuple[bytes, bytes]:
        return b"".join([self.a_bytes[i] for i in a]), b"".join([self.b_bytes[i] for i in b])

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """The ids of each text (it starts with a space, which B adds by
        itself); None if its bytes do not come back."""
        if not texts:
            return []
        out = []
        b_made = self.b.encode([t[1:] for t in texts], num_threads=1)
        for text, a, b in zip(texts, self.a(texts), b_made):
            b, data = b if len(text) > 1 else self.space, text.encode()
            out.append((a, b) if self.bytes_of(a, b) == (data, data) else None)
        return out

    def encode_segments(self, parts: list[str]) -> tuple[np.ndarray, ...]:
        """The ids of all segments one after the other, and for each segment
        how many A and B ids it has and whether its bytes come back. Segments
        that end in a visible character are encoded together, since both
        tokenizers cut between them; where that fails, one by one."""
        joined = [parts[i:i + _TOGETHER] for i in range(0, len(parts), _TOGETHER)]
        visible = [not any(p[-1].isspace() for p in group) for group in joined]
        whole = iter(self.encode(["".join(g) for g, v in zip(joined, visible) if v]))
        a_ids, b_ids, n_a, n_b, ok = [], [], [], [], []
        for group, v in zip(joined, visible):
            made = next(whole) if v else None
            if made is not None:
                a, b = (np.array(x, np.int32) for x in made)
                ends = np.cumsum([len(p.encode()) for p in group])
                cuts = [np.searchsorted(np.cumsum(sizes[x]), ends) + 1 for x, sizes in ((a, self.a_sizes), (b, self.b_sizes))]
                sizes_a, sizes_b = (np.diff(c, prepend=0) for c in cuts)
                good = np.ones(len(group), bool)
            else:
                single = self.encode(group)
                good = np.array([m is not None for m in single])
                single = [m or ([], []) for m in single]
                a, b = (np.array([i for m in single for i in m[k]], np.int32) for k in (0, 1))
                sizes_a, sizes_b = (np.array([len(m[k]) for m in single], np.int64) for k in (0, 1))
            for out, x in zip((a_ids, b_ids, n_a, n_b, ok), (a, b, sizes_a, sizes_b, good)):
                out.append(x)
        kinds = (np.int32, np.int32, np.int64, np.int64, bool)
        return tuple(np.concatenate(x).astype(k) if x else np.zeros(0, k) for x, k in zip((a_ids, b_ids, n_a, n_b, ok), kinds))


def segments(text: str) -> Iterator[list[str]]:
    """A space and the text, cut before every space that follows a visible
    character; in lists of bounded size."""
    text, at = " " + text, 0
    while at < len(text):
        cut = _CUT.search(text, at + _STEP) if len(text) - at > _STEP else None
        end = cut.start() if cut else len(text)
        part = text[at:end]
        if _SPACES.search(part):
            yield _CUT.split(part)
        else:
            yield [" " + w for w in part.split(" ")[1:]]
        at = end


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


TOKENS = (("ids", pa.int64()), ("sizes", pa.int64()), ("flat", pa.int32()), ("a_ids", pa.int32()), ("b_ids", pa.int32()),
          ("n_a", pa.int32()), ("n_b", pa.int32()), ("ok", pa.bool_()))


def tokenized(texts: Texts, own: Tokenizers) -> dict[str, pa.Array]:
    """A block's distinct segments with their tokens, and how many and which
    segments each document has."""
    number: dict[str, int] = {}
    flat, sizes = array("i"), np.zeros(texts.n, np.int64)
    for i in range(texts.n):
        text = texts.strings[i].as_py()
        if text:
            before = len(flat)
            for part in segments(text):
                flat.extend([number.setdefault(s, len(number)) for s in part])
            sizes[i] = len(flat) - before
    # segments that end in white space (of texts that do) stand last
    parts = list(number)
    order = np.argsort(np.fromiter((p[-1].isspace() for p in parts), bool, len(parts)), kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    made = own.encode_segments([parts[i] for i in order.tolist()])
    flat = place[np.frombuffer(flat, np.int32)] if len(flat) else np.zeros(0, np.int32)
    return dict(zip((n for n, _ in TOKENS), (texts.ids, sizes, flat, *made)))


def packed_tokens(tokens: dict) -> bytes:
    lists = []
    for name, kind in TOKENS:
        values = tokens[name] if isinstance(tokens[name], pa.Array) else pa.array(tokens[name]).cast(kind)
        lists.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
    return pack_batch(pa.RecordBatch.from_arrays(lists, [n for n, _ in TOKENS]))


def unpacked_tokens(data) -> dict:
    batch = unpack_batch(data)
    cols = {n: batch.column(i).flatten() for i, (n, _) in enumerate(TOKENS)}
    return {n: c if n == "ids" else c.to_numpy(zero_copy_only=False) for n, c in cols.items()}


class Aligned:
    """The alignment of a block, from its tokens: the links and groups of its
    distinct segments."""

    def __init__(self, tokens: dict, own: Tokenizers):
        self.own = own
        self.sizes, self.flat, self.ok = tokens["sizes"], tokens["flat"], tokens["ok"]
        self.a_ids, self.b_ids = tokens["a_ids"], tokens["b_ids"]
        self.n_a, self.n_b = tokens["n_a"].astype(np.int64), tokens["n_b"].astype(np.int64)
        # documents with a segment that does not come back have no tokens
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.has = self.sizes > 0
        if len(self.flat):
            self.has[self.doc[~self.ok[self.flat]]] = False
        # one link for each place where a token ends, in all segments at once
        a_ends, b_ends = np.cumsum(own.a_sizes[self.a_ids]), np.cumsum(own.b_sizes[self.b_ids])
        ends = np.sort(np.concatenate((a_ends, b_ends)), kind="stable")
        new = np.r_[True, ends[1:] != ends[:-1]] if len(ends) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        ends, self.both = ends[first], np.diff(np.r_[first, len(new)]) == 2
        self.a_of, self.b_of = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        a, b = self.a_ids[self.a_of].astype(np.uint64), self.b_ids[self.b_of].astype(np.uint64)
        self.keys = (b * np.uint64(_SPREAD) & np.uint64(2 ** 32 - 1)) << np.uint64(32) | a
        self.segment = np.repeat(np.arange(len(self.n_a)), self.n_a)[self.a_of] if len(ends) else np.zeros(0, np.int64)

    def per_segment(self, values: np.ndarray) -> np.ndarray:
        """The sum of a value of every link, for each segment."""
        sums = np.r_[np.int64(0), np.cumsum(values.astype(np.int64))]
        bounds = np.searchsorted(self.segment, np.arange(len(self.n_a) + 1))
        return sums[bounds[1:]] - sums[bounds[:-1]]

    def per_document(self, values: np.ndarray) -> np.ndarray:
        """The sum of a value of every segment, for each document."""
        sums = np.r_[np.int64(0), np.cumsum(values[self.flat])] if len(self.flat) else np.zeros(1, np.int64)
        ends = np.cumsum(self.sizes)
        return np.where(self.has, sums[ends] - sums[ends - self.sizes], 0)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs, ascending, and how often the documents link them."""
        used = self.flat[self.has[self.doc]]
        times = np.bincount(used, minlength=len(self.n_a))
        live = times[self.segment] > 0
        order = np.argsort(self.keys[live])
        keys, n = self.keys[live][order], times[self.segment][live][order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return keys[starts], np.add.reduceat(n, starts) if len(starts) else starts

    def group_texts(self) -> list[str]:
        """Each segment's groups as text, each closed by a semicolon."""
        ends = np.flatnonzero(self.both)
        a_end, b_end = self.a_of[ends], self.b_of[ends]  # the last token of every group
        a_last, b_last = np.zeros(len(self.a_ids), bool), np.zeros(len(self.b_ids), bool)
        a_last[a_end], b_last[b_end] = True, True
        # a group's A tokens stand after the B tokens of the groups before it, and so on
        a_group = np.repeat(np.arange(len(ends)), np.diff(a_end, prepend=-1))
        b_group = np.repeat(np.arange(len(ends)), np.diff(b_end, prepend=-1))
        texts = np.empty(len(self.a_ids) + len(self.b_ids), object)
        texts[np.arange(len(self.a_ids)) + np.r_[0, b_end + 1][a_group]] = np.where(a_last, self.own.a_text[1][self.a_ids], self.own.a_text[0][self.a_ids])
        texts[np.arange(len(self.b_ids)) + a_end[b_group] + 1] = np.where(b_last, self.own.b_text[1][self.b_ids], self.own.b_text[0][self.b_ids])
        texts, cuts = texts.tolist(), np.r_[0, np.cumsum(self.n_a + self.n_b)].tolist()
        return ["".join(texts[x:y]) for x, y in zip(cuts, cuts[1:])]

    def group_digests(self) -> list[str]:
        texts, out, at = self.group_texts(), [], 0
        flat = self.flat
        for n, has in zip(self.sizes.tolist(), self.has.tolist()):
            if not has:
                out.append("")
            else:
                sha = hashlib.sha256()
                for k in range(at, at + n, _STEP):
                    end = min(k + _STEP, at + n)
                    part = "".join([texts[i] for i in flat[k:end].tolist()])
                    sha.update((part if end < at + n else part[:-1]).encode())
                out.append(sha.hexdigest())
            at += n
        return out


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: on each level, the keys
    that no other key of the level meets keep a bit; the rest go on. A key's
    place is the rank of its bit."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits, dtype=np.int64) - 1

    @staticmethod
    def spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        h = keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
        return ((h ^ h >> np.uint64(31)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits = [], []
        while len(keys):
            size = max(64, len(keys) * 3 // 2)
            spot = cls.spot(keys, len(sizes), size)
            met = np.bincount(spot, minlength=size)
            sizes.append(size)
            bits.append(met == 1)
            keys = keys[met[spot] > 1]
        return cls(np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool))

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of every key (any place or -1 for other keys)."""
        out = np.full(len(keys), -1, np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            spot = self.spot(keys[open_], level, size) + base
            hit = self.bits[spot]
            out[open_[hit]] = self.rank[spot[hit]]
            open_, base = open_[~hit], base + size
        return out

    def packed(self) -> bytes:
        return np.r_[len(self.sizes), self.sizes].astype(np.int64).tobytes() + np.packbits(self.bits).tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data[:8], np.int64)[0])
        sizes = np.frombuffer(data[8:8 + 8 * n], np.int64)
        bits = np.unpackbits(np.frombuffer(data[8 + 8 * n:], np.uint8), count=int(sizes.sum())).astype(bool)
        return cls(sizes, bits)


class PairTable:
    """The hash of a bucket's pairs and the keys at their places."""

    def __init__(self, row: dict):
        self.hash, self.keys = PerfectHash.unpacked(row["hash"]), np.frombuffer(row["keys"], np.uint64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        at = self.hash.places(keys)
        if not (at >= 0).all() or not (self.keys[at] == keys).all():
            raise ValueError("a pair that is not among the corpus's pairs")
        return at


def token_rows(docs: DataFrame, buckets: int, paths: tuple[str, str], block_bytes: int) -> DataFrame:
    """(bucket, block, keys, counts, tokens): the distinct pairs of every
    block by bucket, and in a row of bucket -1 its tokens."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tokenizers.get(paths)
        for block, _, batch in dealt(batches, block_bytes):
            tokens = tokenized(Texts(batch=batch), own)
            keys, counts = Aligned(tokens, own).pairs()
            bucket, cuts = bucket_slices(keys, 64, buckets)
            spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
            yield pa.RecordBatch.from_arrays([
                pa.array([-1, *bucket.tolist()], pa.int64()), pa.array([block] * (len(bucket) + 1), pa.int64()),
                pa.array([None, *(keys[a:b].tobytes() for a, b in spans)], pa.binary()),
                pa.array([None, *(counts[a:b].astype(np.int64).tobytes() for a, b in spans)], pa.binary()),
                pa.array([packed_tokens(tokens)] + [None] * len(bucket), pa.binary())], ["bucket", "block", "keys", "counts", "tokens"])

    return texts_of(docs).mapInArrow(rows, "bucket long, block long, keys binary, counts binary, tokens binary")


def batch_of(names: list[str], *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in values], names)


def tree(rows_in: DataFrame, leaves: int, work, schema: str) -> DataFrame:
    """One row per bucket from at most ``leaves``, ``FAN`` of them at a time:
    ``work`` unites the rows of a node, of which ``block`` is the number."""
    nodes = leaves
    while True:
        nodes = -(-nodes // FAN)
        rows_in = bucket_map(rows_in.withColumn("node", F.pmod(F.xxhash64("block"), F.lit(nodes))), work, schema, ("bucket", "node"))
        if nodes <= 1:
            return rows_in


def pair_hashes(pairs: DataFrame, leaves: int) -> DataFrame:
    """(bucket, block, hash, keys): a minimal perfect hash for each bucket."""
    def unite(found: list[dict]) -> pa.RecordBatch:
        keys = np.unique(np.frombuffer(b"".join(r["keys"] for r in found), np.uint64))
        return batch_of(["bucket", "block", "keys"], found[0]["bucket"], found[0]["node"], keys.tobytes())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = np.frombuffer(data, np.uint64)
                made = PerfectHash.of(keys)
                at = np.empty_like(keys)
                at[made.places(keys)] = keys
                yield batch_of(["bucket", "block", "hash", "keys"], bucket, -1, made.packed(), at.tobytes())

    united = tree(pairs.select("bucket", "block", "keys"), leaves, unite, "bucket long, block long, keys binary")
    return united.select("bucket", "keys").mapInArrow(rows, "bucket long, block long, hash binary, keys binary")


def beside(rows_in: DataFrame, tables: DataFrame, nodes: int) -> DataFrame:
    """The blocks' rows dealt to ``nodes`` nodes of each bucket, the bucket's
    row of ``tables`` before those of every node."""
    node = F.pmod(F.xxhash64("block"), F.lit(nodes)).cast("long").alias("node")
    heads = tables.withColumn("node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nodes - 1).cast("long"))))
    return heads.unionByName(rows_in.select("*", node), allowMissingColumns=True)


def pair_sums(pairs: DataFrame, hashes: DataFrame, leaves: int) -> DataFrame:
    """(bucket, block, hash, keys, sums): for every pair, at its place, how
    often the corpus links it."""
    nodes = -(-leaves // FAN)

    def dense(found: list[dict]) -> pa.RecordBatch:
        head, rest = found[0], found[1:]
        own = PairTable(head)
        vector = np.zeros(len(own.keys), np.int64)
        for r in rest:  # a block's keys are distinct
            vector[own.places(np.frombuffer(r["keys"], np.uint64))] += np.frombuffer(r["counts"], np.int64)
        return batch_of(["bucket", "block", "vector"], head["bucket"], head["node"], vector.tobytes())

    def add(found: list[dict]) -> pa.RecordBatch:
        vector = np.sum([np.frombuffer(r["vector"], np.int64) for r in found], axis=0)
        return batch_of(["bucket", "block", "vector"], found[0]["bucket"], found[0]["node"], vector.tobytes())

    vectors = bucket_map(beside(pairs, hashes, nodes), dense, "bucket long, block long, vector binary", ("bucket", "node"))
    if nodes > 1:
        vectors = tree(vectors, nodes, add, "bucket long, block long, vector binary")
    return hashes.join(vectors.select("bucket", F.col("vector").alias("sums")), "bucket")


def best_of(keys: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Whether a pair's count is the highest of its B id."""
    order = np.argsort(keys)
    b = keys[order] >> np.uint64(32)
    starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    out = np.zeros(len(keys), bool)
    if len(starts):
        highest = np.maximum.reduceat(sums[order], starts)
        out[order] = sums[order] == np.repeat(highest, np.diff(np.r_[starts, len(b)]))
    return out


def looked_up(pairs: DataFrame, sums: DataFrame, leaves: int) -> DataFrame:
    """For every pair of a block: twice its sum, and one if it is the highest
    of its B id."""
    def work(found: list[dict]) -> pa.RecordBatch:
        head, rest = found[0], found[1:]
        own, total = PairTable(head), np.frombuffer(head["sums"], np.int64)
        answers = total * 2 + best_of(own.keys, total)
        return answer_batch([(r["bucket"], r["block"], answers[own.places(np.frombuffer(r["keys"], np.uint64))].tobytes()) for r in rest])

    return bucket_map(beside(pairs.drop("counts"), sums, -(-leaves // FAN)), work, ANSWER, ("bucket", "node"))


ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


class Alignment:
    """The stored tables of a corpus's alignment."""

    def __init__(self, docs: DataFrame, paths: tuple[str, str] | None = None, block_bytes: int = BLOCK_BYTES,
                 buckets: int = BUCKETS):
        self.paths = paths or tokenizer_paths()
        rows = stored(token_rows(docs, buckets, self.paths, block_bytes), "tokens")
        self.tokens = rows.where("bucket = -1").select("block", "tokens")
        self.pairs = rows.where("bucket >= 0").drop("tokens")
        self.leaves = max(1, self.tokens.count())
        hashes = stored(pair_hashes(self.pairs, self.leaves), "pair-hashes")
        self.sums = stored(pair_sums(self.pairs, hashes, self.leaves), "pair-sums")

    def counts(self) -> DataFrame:
        """(a_id, b_id, n): the distinct pairs of ids with their counts."""
        back = pow(_SPREAD, -1, 2 ** 32)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    keys = np.frombuffer(data, np.uint64)
                    b = (keys >> np.uint64(32)) * np.uint64(back) & np.uint64(2 ** 32 - 1)
                    yield pa.RecordBatch.from_arrays([pa.array((keys & np.uint64(2 ** 32 - 1)).astype(np.int64)), pa.array(b.astype(np.int64)),
                                                      pa.array(np.frombuffer(sums, np.int64))], ["a_id", "b_id", "n"])

        return self.sums.select("keys", "sums").mapInArrow(rows, "a_id long, b_id long, n long")

    def documents(self) -> DataFrame:
        """One row per document: tokens, groups, links and their counts."""
        paths = self.paths

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Tokenizers.get(paths)
            for batch in batches:
                for data, answers in zip(batch.column(0), batch.column(1)):
                    tokens = unpacked_tokens(data.as_buffer())
                    at = Aligned(tokens, own)
                    keys, _ = at.pairs()
                    known = np.frombuffer(answer_bytes(answers), np.int64)
                    # links of segments that only documents without tokens have are not among them
                    place = np.minimum(np.searchsorted(keys, at.keys), max(0, len(keys) - 1))
                    answer = known[place] * (keys[place] == at.keys) if len(keys) else np.zeros(len(at.keys), np.int64)
                    cols = [at.n_a, at.n_b, at.per_segment(at.both), at.per_segment(np.ones(len(at.keys))),
                            at.per_segment(answer & 1), at.per_segment(answer >> 1)]
                    yield pa.RecordBatch.from_arrays([tokens["ids"], *(pa.array(at.per_document(c)) for c in cols), pa.array(at.group_digests(), pa.string())],
                                                     [f.split()[0] for f in ALIGNED.split(", ")])

        asked = with_answers(self.tokens, answers=looked_up(self.pairs, self.sums, self.leaves))
        return asked.select("tokens", "answers").mapInArrow(rows, ALIGNED)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Alignment(table(spark, sf_dir, "documents")).documents()


QUERIES = {"op11_token_alignment": op11_token_alignment}
ORACLE_SQL: dict[str, str] = {}
