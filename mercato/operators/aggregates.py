"""Aggregations.

Every group-by here is a hash aggregate with a map-side partial step, so a
hot key is collapsed to one row per input partition before the shuffle.
Group keys that come from left-joined attributes are filtered to non-null
first (pandas drops null keys; Spark would keep a null group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import columns as C
from .prefix import exact_percentiles, join_one_row, percentile_row, with_scalars


def _nn(df: DataFrame, *cols: str) -> DataFrame:
    cond = None
    for c in cols:
        cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
    return df.where(cond) if cond is not None else df


# A1 -------------------------------------------------------------------------
def weekly_sales(tx: DataFrame, key: str = "article_id", date_col: str = "t_dat",
                 price_col: str = "price") -> DataFrame:
    """Per (article, Monday week): units = rows, avg_price = mean price."""
    return (tx.select(key, C.week_start(date_col).alias("week"),
                      F.col(price_col).cast("double").alias("_price"))
              .where(F.col(key).isNotNull() & F.col("week").isNotNull())
              .groupBy(key, "week")
              .agg(F.count(F.lit(1)).alias("units_sold"), F.avg("_price").alias("avg_price")))


# A2 -------------------------------------------------------------------------
def monthly_volume(tx: DataFrame, date_col: str = "t_dat") -> DataFrame:
    return (tx.select(C.month_start(date_col).alias("month")).where(F.col("month").isNotNull())
              .groupBy("month").agg(F.count(F.lit(1)).alias("n_transactions")))


# A3 -------------------------------------------------------------------------
def sales_per_article(tx: DataFrame, key: str = "article_id") -> DataFrame:
    return _nn(tx, key).groupBy(key).agg(F.count(F.lit(1)).alias("n_sales"))


# A4 -------------------------------------------------------------------------
DEFAULT_PCTS = {"p01": 0.01, "p50": 0.50, "p95": 0.95, "p99": 0.99}


def describe(df: DataFrame, col: str, pcts: dict[str, float] | None = None) -> DataFrame:
    """count, mean, sample std, min, exact percentiles, max in one row."""
    pcts = DEFAULT_PCTS if pcts is None else pcts
    x = F.col(col).cast("double")
    basic = df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"),
                   F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return join_one_row(basic, percentile_row(df, col, pcts)).select(
        "count", "mean", "std", "min", *pcts.keys(), "max")


# A6 -------------------------------------------------------------------------
def return_rate_by(df: DataFrame, col: str, label: str = "returned") -> DataFrame:
    return (_nn(df, col).groupBy(col)
              .agg(F.avg(F.col(label).cast("double")).alias("return_rate"),
                   F.count(F.lit(1)).alias("n_transactions")))


# A7 -------------------------------------------------------------------------
def value_counts(df: DataFrame, col: str) -> DataFrame:
    return _nn(df, col).groupBy(col).agg(F.count(F.lit(1)).alias("count"))


# A8 -------------------------------------------------------------------------
def article_return_risk(scored: DataFrame, prob: str = "return_prob", label: str = "returned",
                        key: str = "article_id") -> DataFrame:
    return (_nn(scored, key).groupBy(key)
              .agg(F.avg(F.col(prob).cast("double")).alias("avg_return_prob"),
                   F.avg(F.col(label).cast("double")).alias("actual_return_rate"),
                   F.count(F.lit(1)).alias("n_transactions")))


# A9 -------------------------------------------------------------------------
def article_demand(pred: DataFrame, key: str = "article_id", y: str = "units_sold",
                   yhat: str = "y_pred", price: str = "avg_price",
                   price_to_eur: float = P.PRICE_TO_EUR) -> DataFrame:
    return (_nn(pred, key).groupBy(key)
              .agg(F.sum(F.col(y).cast("double")).alias("actual_demand"),
                   F.sum(F.col(yhat).cast("double")).alias("predicted_demand"),
                   F.avg(F.col(price).cast("double")).alias("avg_price"))
              .withColumn("avg_price_eur", F.col("avg_price") * F.lit(price_to_eur)))


# A10 ------------------------------------------------------------------------
def risk_matrix(df: DataFrame, row: str = "garment_group_name", column: str = "colour_group_name",
                risk: str = "avg_return_prob", min_n: int = 20) -> DataFrame:
    return (_nn(df, row, column).groupBy(row, column)
              .agg(F.avg(risk).alias("return_rate"), F.count(F.lit(1)).alias("n"))
              .where(F.col("n") >= min_n))


# A11 ------------------------------------------------------------------------
def risk_by_garment(df: DataFrame, col: str = "garment_group_name", risk: str = "avg_return_prob",
                    min_n: int = 30, top: int = 15) -> DataFrame:
    """Groups with n >= min_n, the ``top`` riskiest (ties by name)."""
    g = (_nn(df, col).groupBy(col)
           .agg(F.count(F.lit(1)).alias("n_products"), F.avg(risk).alias("return_rate"))
           .where(F.col("n_products") >= min_n))
    return g.orderBy(F.col("return_rate").desc(), F.col(col).asc()).limit(top)


# A12 ------------------------------------------------------------------------
def cluster_profile(df: DataFrame, cluster: str = "cluster", risk: str | None = "avg_return_prob",
                    modes: dict[str, str] | None = None) -> DataFrame:
    """Per cluster: size, mean risk and the modal value of each attribute
    (lowest value on ties, 'N/A' when the group has no value)."""
    modes = modes or {"top_garment": "garment_group_name", "top_color": "colour_group_name",
                      "top_dept": "department_name"}
    aggs = [F.count(F.lit(1)).alias("n_products")]
    if risk:
        aggs.append(F.avg(risk).alias("return_rate"))
    aggs += [F.coalesce(F.mode(F.col(c), True), F.lit(P.NO_MODE)).alias(name) for name, c in modes.items()]
    return _nn(df, cluster).groupBy(cluster).agg(*aggs)


# A13 ------------------------------------------------------------------------
def n_unique(df: DataFrame, col: str, approx: bool = False) -> DataFrame:
    f = F.approx_count_distinct(col) if approx else F.count_distinct(col)
    return df.agg(f.alias(f"n_unique_{col}"))


# A14 ------------------------------------------------------------------------
def style_kpis(df: DataFrame, risk: str = "avg_return_prob", cluster: str = "cluster",
               high: float = P.HIGH_RISK_KPI) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_articles"), F.avg(risk).alias("mean_risk"),
                  F.count_distinct(cluster).alias("n_clusters"),
                  F.count_if(F.col(risk) > high).alias("n_high_risk")).select(
        "*", (F.lit(100.0) * F.col("n_high_risk") / F.col("n_articles")).alias("pct_high_risk"))


# A15 ------------------------------------------------------------------------
def risk_tiers(df: DataFrame, risk: str = "avg_return_prob") -> DataFrame:
    """Tier counts and shares of all rows, in one aggregate pass."""
    tier = C.risk_tier(risk)
    labels = ("low", "mid", "high")
    agg = df.agg(F.count(F.lit(1)).alias("_all"),
                 *[F.count_if(tier == F.lit(t)).alias(f"_n_{t}") for t in labels])
    rows = F.array(*[F.struct(F.lit(t).alias("tier"), F.col(f"_n_{t}").alias("n"),
                              (F.lit(100.0) * F.col(f"_n_{t}") / F.col("_all")).alias("pct"))
                     for t in labels])
    return agg.select(F.explode(rows).alias("_r")).select("_r.*")


# A16 ------------------------------------------------------------------------
def article_calibration(df: DataFrame, risk: str = "avg_return_prob",
                        actual: str = "actual_return_rate", n_col: str = "n_transactions",
                        min_tx: int = 5, bins: int = 10, min_n: int = 10) -> DataFrame:
    """Articles with >= min_tx transactions, right-closed bins on
    [0, p99] (lowest edge included, above p99 dropped), bins with >= min_n."""
    base = df.where(F.col(n_col) >= min_tx)
    p99 = percentile_row(base, risk, {"_p99": 0.99})
    x = with_scalars(base.select(risk, actual), p99)
    step = F.col("_p99") / F.lit(float(bins))
    binned = (x.where((F.col(risk) >= 0) & (F.col(risk) <= F.col("_p99")))
               .withColumn("bin", C.right_closed_bin(risk, step, bins)))
    return (binned.groupBy("bin")
                  .agg(F.avg(risk).alias("pred_mean"), F.avg(actual).alias("actual_mean"),
                       F.count(F.lit(1)).alias("n"))
                  .where(F.col("n") >= min_n))


# A17 ------------------------------------------------------------------------
def article_forecast_summary(pred: DataFrame, key: str = "article_id", y: str = "units_sold",
                             yhat: str = "y_pred", week: str = "week") -> DataFrame:
    ae = F.abs(F.col(yhat) - F.col(y))
    return (_nn(pred, key).groupBy(key)
              .agg(F.count(week).alias("n_weeks"), F.sum(y).alias("total_sold"),
                   F.try_divide(F.sum(ae), F.sum(F.abs(F.col(y)))).alias("wape")))


# A18 ------------------------------------------------------------------------
def product_kpis(pred: DataFrame, key: str = "article_id", y: str = "units_sold",
                 yhat: str = "y_pred") -> DataFrame:
    """Per product: WAPE (0 when nothing sold), units sold, units predicted
    (both truncated to whole units, as displayed) and their difference."""
    ae = F.abs(F.col(yhat) - F.col(y))
    g = _nn(pred, key).groupBy(key).agg(
        F.sum(ae).alias("_ae"), F.sum(F.abs(F.col(y))).alias("_ay"),
        F.sum(F.col(y)).alias("_y"), F.sum(F.col(yhat)).alias("_yhat"))
    return g.select(
        key,
        F.when(F.col("_y") > 0, F.col("_ae") / F.col("_ay")).otherwise(F.lit(0.0)).alias("wape"),
        F.col("_y").cast("long").alias("total_sold"),
        F.col("_yhat").cast("long").alias("total_pred"),
        (F.col("_yhat").cast("long") - F.col("_y").cast("long")).alias("diff"))


# A19 ------------------------------------------------------------------------
def split_profile(df: DataFrame, split: str = "split", week: str = "week",
                  label: str | None = None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.min(week).alias("min_week"),
            F.max(week).alias("max_week")]
    if label:
        aggs.append(F.avg(F.col(label).cast("double")).alias("positive_rate"))
    return df.groupBy(split).agg(*aggs)


# A20 ------------------------------------------------------------------------
def target_profile(df: DataFrame, col: str = "units_sold") -> DataFrame:
    x = F.col(col).cast("double")
    basic = df.agg(F.avg(x).alias("mean"), F.max(x).alias("max"))
    pct = percentile_row(df, col, {"median": 0.5, "p999": 0.999})
    return join_one_row(basic, pct).select("mean", "median", "max", "p999")


# A21 ------------------------------------------------------------------------
def forecast_kpis(pred: DataFrame, key: str = "article_id", y: str = "units_sold",
                  yhat: str = "y_pred") -> DataFrame:
    err = F.col(yhat) - F.col(y)
    return pred.agg(F.count_distinct(key).alias("n_articles"), F.count(F.lit(1)).alias("n_predictions"),
                    F.avg(err).alias("bias"),
                    F.try_divide(F.sum(F.abs(err)), F.sum(F.abs(F.col(y)))).alias("wape"))


def percentiles_long(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    return exact_percentiles(df, col, probs, by)
