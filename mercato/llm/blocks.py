"""Blocks of documents and packed exchanges between them and key buckets.

``blocks`` stores the documents as rows of some megabytes, compressed: texts
move between stages as few large rows, and a task can work on all texts of a
block by arrays. What a block wants to know about its keys goes out as one
row per (bucket, block) with the block's distinct keys, so a key that a
third of all documents have is one entry per block; ``bucket_map`` hands all
rows of a bucket to one call and ``with_answers`` takes what it returns back
to the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored

BLOCK_BYTES = 4 << 20
LAST_ID = 2 ** 63 - 1  # stands for a null doc_id


def pack_batch(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 7))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_batch(data) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


class Texts:
    """The texts of a block as one array of bytes and where each starts."""

    def __init__(self, payload=None, batch: pa.RecordBatch | None = None):
        batch = unpack_batch(payload) if batch is None else batch
        text = batch.column(1)
        self.ids = batch.column(0)
        self.n = batch.num_rows
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + self.n + 1]
        held = text.buffers()[2]
        self.data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
        self.data, self.starts = self.data[offsets[0]:offsets[-1]], offsets - offsets[0]
        self.strings = text

    def keys(self) -> np.ndarray:
        """The doc_ids, null as ``LAST_ID``."""
        return self.ids.fill_null(LAST_ID).to_numpy(zero_copy_only=False)


def dealt(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Number, bytes of text and rows of the blocks of a partition."""
    from pyspark import TaskContext
    number, held, size = TaskContext.get().partitionId() << 32, [], 0

    def made() -> tuple[int, int, pa.RecordBatch]:
        return number, size, pa.RecordBatch.from_arrays([pa.concat_arrays([p.column(i) for p in held]) for i in (0, 1)], ["doc_id", "text"])

    for batch in batches:
        batch = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.large_string()),
                                            batch.column(2).cast(pa.int64())], ["doc_id", "text", "n"])
        sizes = np.cumsum(batch.column(2).to_numpy())
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + block_bytes - size, "right")))
            if held and size + sizes[end - 1] - before > block_bytes:
                yield made()
                number, held, size = number + 1, [], 0
                continue
            held.append(batch.slice(at, end - at))
            size += int(sizes[end - 1] - before)
            at = end
    if held:
        yield made()


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and its bytes, for ``dealt``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).alias("n"))


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Stored (block, n_bytes, payload): doc_id and text (null as empty) of
    the documents, about ``block_bytes`` of text per row; a longer text is a
    block of its own."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, n, one in dealt(batches, block_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([n]), pa.array([pack_batch(one)], pa.binary())],
                                             ["block", "n_bytes", "payload"])

    return stored(texts_of(docs).mapInArrow(rows, "block long, n_bytes long, payload binary"), "blocks")


def bucket_count(held: DataFrame, bucket_bytes: int) -> int:
    """As many buckets as the texts have ``bucket_bytes``, 65,536 at most."""
    total = held.agg(F.sum("n_bytes")).first()[0] or 0
    return int(min(1 << 16, max(1, -(-total // bucket_bytes))))


def bucket_slices(keys: np.ndarray, bits: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For ascending keys of ``bits`` bits: the buckets that they fall in and
    the bounds of each one's run."""
    bucket = (keys >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)
    cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(keys)] if len(keys) else np.zeros(1, np.int64)
    return bucket[cuts[:-1]].astype(np.int64), cuts


def bucket_map(rows_in: DataFrame, work: Callable[[list[dict]], pa.RecordBatch], schema: str, by: tuple = ("bucket",)) -> DataFrame:
    """``work(rows)`` once for each value of ``by``, with all its rows in the
    order of their block."""
    names = rows_in.columns
    places = [names.index(c) for c in by]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in places))):
                if key != current and held:
                    yield work(held)
                    held = []
                current = key
                held.append({n: batch.column(k)[i].as_py() for k, n in enumerate(names)})
        if held:
            yield work(held)

    n = shuffle_partitions(rows_in.sparkSession)
    return rows_in.repartition(n, *by).sortWithinPartitions(*by, "block").mapInArrow(rows, schema)


ANSWER = "bucket long, block long, answer binary"


def answer_batch(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in found], pa.int64()), pa.array([b for _, b, _ in found], pa.int64()),
                                       pa.array([a for _, _, a in found], pa.binary())], ["bucket", "block", "answer"])


def with_answers(held: DataFrame, **answers: DataFrame) -> DataFrame:
    """The blocks, each with an array of (bucket, answer) per name, in the
    order of the buckets, empty where the block asked for nothing."""
    out = held
    for name, answer in answers.items():
        of = answer.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "answer"))).alias(name))
        out = out.join(of, "block", "left")
    return out


def answer_bytes(cell) -> bytes:
    """The answers of a block's buckets, one after the other."""
    return b"" if not cell.is_valid else b"".join(cell.values.field(1).to_pylist())
