"""Shared pieces of the training-data operators: table access, word blocks,
sorted groups, and the fixed white-space and word classes. ``stored`` cuts a
plan; ``mercato.session.drop_stored`` deletes what it wrote."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, stored  # noqa: F401  (the operators take them from here)

# The white space and the words of the query contracts.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def own_name() -> str:
    """A name that no column of the documents has."""
    return f"_row_{uuid.uuid4().hex}"


def keyed(docs: DataFrame, own: str) -> DataFrame:
    """``docs`` with a column ``own``: doc_id and it tell every row from all
    others. Rows whose doc_id is null or repeated are stored with a number
    each; where the doc_id is enough, ``own`` is null and nothing is stored."""
    numbered = docs.where(F.col("doc_id").isNull())
    plain = docs.where(F.col("doc_id").isNotNull())
    shared = stored(plain.groupBy(F.col("doc_id").alias("_shared_id")).agg(F.count(F.lit(1)).alias("_n"))
                    .where("_n > 1").select("_shared_id"), "shared-ids")
    if not shared.isEmpty():
        of = F.col("doc_id") == F.col("_shared_id")
        numbered = numbered.unionByName(plain.join(shared, of, "left_semi"))
        plain = plain.join(shared, of, "left_anti")
    numbered = stored(numbered.withColumn(own, F.monotonically_increasing_id()), "numbered")
    return plain.withColumn(own, F.lit(None).cast("long")).unionByName(numbered)


def same_row(a: DataFrame, b: DataFrame, own: str, b_id: str, b_own: str) -> Column:
    return a["doc_id"].eqNullSafe(b[b_id]) & a[own].eqNullSafe(b[b_own])


def first_row(own: str) -> Column:
    """The row with the smallest doc_id, nulls last, then the smallest number."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col(own).alias("own")))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


_SPACE_BYTES = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text in lists of bounded size; ``bytes.split``
    splits at exactly the white space of ``SPACE``."""
    start = 0
    while start < len(data):
        end = start + size
        cut = _SPACE_BYTES.search(data, end) if end < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[start:end].split()
        start = end


def sorted_groups(batches: Iterator, key: str, *values: str) -> Iterator[tuple]:
    """Groups of a partition that is sorted by ``key`` (a whole number): per
    step the arrays of key starts, group sizes and each value column, for the
    groups that are complete. Holds one batch and one unfinished group."""
    held = None
    for batch in batches:
        cols = [np.asarray(batch.column(c)) for c in (key, *values)]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        if not len(cols[0]):
            continue
        starts = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
        last = starts[-1]
        held = [c[last:] for c in cols]
        if last:
            yield (starts[:-1], np.diff(starts), *[c[:last] for c in cols[1:]])
    if held is not None and len(held[0]):
        yield (np.array([0]), np.array([len(held[0])]), *held[1:])
