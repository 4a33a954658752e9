"""Window features of the article x week feature store.

All per-article windows share one ``partitionBy('article_id').orderBy('week')``
spec, so Spark shuffles and sorts once for lags, rolling means and the
catalogue age. Rows per article are bounded by the number of weeks (the
weekly aggregate collapses any hot article first), so no window task grows
with the fact table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import params as P
from ..functions import columns as C
from ..session import stored
from .prefix import running_totals


def article_window(key: str = "article_id", order: str = "week"):
    return W.partitionBy(key).orderBy(order)


# W1 -------------------------------------------------------------------------
def with_lags(df: DataFrame, lags: Sequence[int] = P.LAGS, col: str = "units_sold",
              key: str = "article_id", order: str = "week") -> DataFrame:
    """Previous observed rows (not calendar weeks) of ``col`` per article."""
    w = article_window(key, order)
    return df.select("*", *[F.lag(col, k).over(w).cast("double").alias(f"lag_{k}") for k in lags])


# W2 -------------------------------------------------------------------------
def with_rolling_mean(df: DataFrame, windows: Sequence[int] = P.ROLLING_WINDOWS,
                      col: str = "units_sold", key: str = "article_id",
                      order: str = "week") -> DataFrame:
    """Mean of the previous n rows of the same article, current row excluded,
    null when there is no previous row (min one value)."""
    w = article_window(key, order)
    return df.select("*", *[F.avg(F.col(col).cast("double")).over(w.rowsBetween(-n, -1))
                            .alias(f"rolling_mean_{n}") for n in windows])


# W3 -------------------------------------------------------------------------
def with_weeks_in_catalog(df: DataFrame, key: str = "article_id", order: str = "week") -> DataFrame:
    first = F.min(order).over(W.partitionBy(key))
    return df.withColumn("weeks_in_catalog",
                         F.floor(F.datediff(F.col(order), first) / F.lit(7)).cast("int"))


# C4 / C5 / C6 -------------------------------------------------------------------
def with_calendar(df: DataFrame, col: str = "week", quarter: bool = False,
                  day_of_week: bool = False, cyclic: bool = False) -> DataFrame:
    out = [F.month(col).alias("month"), C.iso_week(col).alias("week_of_year")]
    if quarter:
        out.append(F.quarter(col).alias("quarter"))
    if day_of_week:
        out.append(C.day_of_week_monday0(col).alias("day_of_week"))
    df = df.select("*", *out)
    if cyclic:
        df = df.select("*", C.month_sin("month").alias("month_sin"),
                       C.month_cos("month").alias("month_cos"))
    return df


def with_log1p(df: DataFrame, cols: Sequence[str], prefix: str = "log_") -> DataFrame:
    return df.select("*", *[F.log1p(F.col(c)).alias(f"{prefix}{c}") for c in cols])


# W4 -------------------------------------------------------------------------
def with_group_median(df: DataFrame, key: str, col: str, name: str) -> DataFrame:
    """Attach the exact median of ``col`` within each ``key`` group to every
    row. Medians come from sketch brackets and exact ranks inside them (no
    group is ever gathered in one task); the stored result has one row per
    group, so the planner knows its size and broadcasts it under its
    threshold instead of shuffling the rows on ``key``. Rows with a null key
    get a null median."""
    return df.join(group_medians(df, key, col, name), key, "left")


def group_medians(df: DataFrame, key: str, col: str, name: str) -> DataFrame:
    from .prefix import group_percentile
    return stored(group_percentile(df.where(F.col(key).isNotNull()), col, 0.5, [key], name), "medians")


# W5 -------------------------------------------------------------------------
def pareto_curve(sales: DataFrame, key: str = "article_id", col: str = "n_sales") -> DataFrame:
    """Articles by sales descending (ties by key): rank, cumulative share %
    and rank share %. Global order via range-partitioned running totals."""
    base = sales.select(key, F.col(col).cast("long").alias(col), F.lit(1).cast("long").alias("_one"))
    cum = running_totals(base, [(col, False), (key, True)], [col, "_one"])
    return cum.select(
        key, col,
        F.col("cum__one").alias("rank"),
        (F.lit(100.0) * F.col(f"cum_{col}") / F.col(f"total_{col}")).alias("cum_share_pct"),
        (F.lit(100.0) * F.col("cum__one") / F.col("total__one")).alias("article_pct"))


# W6 -------------------------------------------------------------------------
def pareto_points(sales: DataFrame, pcts: Sequence[int] = (10, 20, 50),
                             key: str = "article_id", col: str = "n_sales") -> DataFrame:
    """One row per pct: top_pct, n_top, share_pct."""
    base = sales.select(key, F.col(col).cast("long").alias(col), F.lit(1).cast("long").alias("_one"))
    cum = running_totals(base, [(col, False), (key, True)], [col, "_one"])
    pct_arr = F.explode(F.array(*[F.lit(int(p)) for p in pcts])).alias("top_pct")
    rows = cum.select(key, col, "cum__one", "total__one", f"total_{col}", pct_arr)
    n_top = F.floor(F.col("total__one") * F.col("top_pct") / F.lit(100)).cast("long")
    return (rows.groupBy("top_pct")
                .agg(F.max(n_top).alias("n_top"),
                     F.sum(F.when(F.col("cum__one") <= n_top, F.col(col)).otherwise(F.lit(0)))
                      .alias("_top_sales"),
                     F.max(f"total_{col}").alias("_all"))
                .select("top_pct", "n_top",
                        (F.lit(100.0) * F.col("_top_sales") / F.col("_all")).alias("share_pct")))
