"""Filters and predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import params as P


# F1 -------------------------------------------------------------------------
def drop_incomplete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


# F2 -------------------------------------------------------------------------
def min_history(weekly: DataFrame, n: int = P.MIN_WEEKS_OVERALL, key: str = "article_id") -> DataFrame:
    """Keep every row of the keys that have at least ``n`` rows.

    A count window partitioned by the key (rows per key are bounded by the
    number of weeks) instead of aggregate + semi-join: the exchange on the key
    is shared with the lag windows that follow.
    """
    cnt = F.count(F.lit(1)).over(W.partitionBy(key))
    return weekly.withColumn("_n_rows", cnt).where(F.col("_n_rows") >= n).drop("_n_rows")


def history_report(weekly: DataFrame, n: int = P.MIN_WEEKS_OVERALL, key: str = "article_id") -> DataFrame:
    """A5: articles total / kept / kept %."""
    per = weekly.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(F.count(F.lit(1)).alias("n_articles"),
                   F.count_if(F.col("_n") >= n).alias("n_kept")).select(
        "n_articles", "n_kept",
        (F.lit(100.0) * F.col("n_kept") / F.col("n_articles")).alias("kept_pct"))


# F3 -------------------------------------------------------------------------
def cold_start_filter(weekly: DataFrame, train_end: str, n: int = P.COLD_START_MIN_WEEKS,
                      key: str = "article_id", week: str = "week") -> DataFrame:
    """Keep all rows of keys with at least ``n`` rows on or before ``train_end``."""
    in_train = F.count_if(F.col(week) <= F.lit(train_end).cast("date")).over(W.partitionBy(key))
    return weekly.withColumn("_n_train", in_train).where(F.col("_n_train") >= n).drop("_n_train")


# F4 / F5 ----------------------------------------------------------------------
def with_split(df: DataFrame, col: str, train_end: str, val_end: str,
               test_end: str | None = None, name: str = "split") -> DataFrame:
    """Label rows train (-inf, a], val (a, b], test (b, c] (or (b, inf)).
    Rows past ``test_end`` or with a null date get no label and are dropped."""
    c = F.col(col)
    a, b = F.lit(train_end).cast("date"), F.lit(val_end).cast("date")
    test_cond = (c > b) if test_end is None else ((c > b) & (c <= F.lit(test_end).cast("date")))
    lab = F.when(c <= a, "train").when((c > a) & (c <= b), "val").when(test_cond, "test")
    return df.withColumn(name, lab).where(F.col(name).isNotNull())


def temporal_split(df: DataFrame, col: str, train_end: str, val_end: str,
                   test_end: str | None = None):
    """(train, val, test) frames; one labelled plan filtered three ways."""
    s = with_split(df, col, train_end, val_end, test_end, "_split")
    return tuple(s.where(F.col("_split") == k).drop("_split") for k in ("train", "val", "test"))


# F6 -------------------------------------------------------------------------
def holdout_cutoff(df: DataFrame, k: int = P.HOLDOUT_WEEKS, col: str = "week") -> DataFrame:
    """One-row frame: the k-th largest distinct value of ``col``."""
    return (df.select(col).where(F.col(col).isNotNull()).distinct()
              .orderBy(F.col(col).desc()).limit(k).agg(F.min(col).alias("cutoff")))


def with_holdout(df: DataFrame, k: int = P.HOLDOUT_WEEKS, col: str = "week",
                 name: str = "split") -> DataFrame:
    """Label the last ``k`` distinct weeks 'test', the rest 'train'; rows
    without a week are in neither.
    The cutoff is a scalar subquery (a top-k over distinct weeks)."""
    cut = holdout_cutoff(df, k, col).scalar()
    return (df.where(F.col(col).isNotNull())
              .withColumn(name, F.when(F.col(col) >= cut, "test").otherwise("train")))


# F7 -------------------------------------------------------------------------
def having(df: DataFrame, col: str, n) -> DataFrame:
    return df.where(F.col(col) >= n)


# F8 -------------------------------------------------------------------------
def drilldown(df: DataFrame, col: str, value, order_by: Sequence[str] = ()) -> DataFrame:
    out = df.where(F.col(col) == F.lit(value))
    return out.orderBy(*order_by) if order_by else out


# F9 -------------------------------------------------------------------------
def top_categories(df: DataFrame, col: str, n: int) -> DataFrame:
    """The ``n`` most frequent non-null values of ``col`` (ties by value)."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_cnt"))
              .orderBy(F.col("_cnt").desc(), F.col(col).asc()).limit(n).select(col))


def top_category_filter(df: DataFrame, col: str, n: int) -> DataFrame:
    """Rows whose ``col`` is among the top ``n`` values (semi-join against a
    list of at most ``n`` rows, broadcast)."""
    return df.join(F.broadcast(top_categories(df, col, n)), col, "left_semi")


def top_categories_filter(df: DataFrame, tops: dict[str, int]) -> DataFrame:
    """Rows whose every column of ``tops`` is among that column's top values.
    All lists are counted on ``df`` itself, none on what another has left."""
    out = df
    for col, n in tops.items():
        out = out.join(F.broadcast(top_categories(df, col, n)), col, "left_semi")
    return out
