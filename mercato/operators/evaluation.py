"""Forecast and classifier evaluation.

Every metric is one aggregation pass. Rank metrics (ROC-AUC, average
precision, curve points) first collapse rows to one row per distinct score
(map-side combined), then take running counts in score order with the
range-partitioned prefix sums of :mod:`prefix` — exact, tie-aware, and never a
single-partition window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import group_percentile, running_totals


# E1 -------------------------------------------------------------------------
def wape(y, yhat) -> Column:
    """Σ|y - ŷ| / Σ|y| as an aggregate expression; null when Σ|y| = 0."""
    y, yhat = (F.col(y) if isinstance(y, str) else y), (F.col(yhat) if isinstance(yhat, str) else yhat)
    return F.try_divide(F.sum(F.abs(y - yhat)), F.sum(F.abs(y)))


# E2 -------------------------------------------------------------------------
def regression_metrics(df: DataFrame, y: str, preds: Mapping[str, str]) -> DataFrame:
    """One row per model: WAPE, MAE, RMSE, n — all models in one pass."""
    aggs = [F.count(F.lit(1)).alias("_n"), F.sum(F.abs(F.col(y))).alias("_ay")]
    for name, c in preds.items():
        e = F.col(c) - F.col(y)
        aggs += [F.sum(F.abs(e)).alias(f"_ae_{name}"), F.sum(e * e).alias(f"_se_{name}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(
        F.lit(name).alias("model"),
        F.try_divide(F.col(f"_ae_{name}"), F.col("_ay")).alias("wape"),
        F.try_divide(F.col(f"_ae_{name}"), F.col("_n")).alias("mae"),
        F.sqrt(F.try_divide(F.col(f"_se_{name}"), F.col("_n"))).alias("rmse"),
        F.col("_n").alias("n")) for name in preds])
    return one.select(F.explode(rows).alias("_r")).select("_r.*")


# C15 ------------------------------------------------------------------------
def fill_median(df: DataFrame, col: str, fit_on: DataFrame | None = None,
                name: str | None = None) -> DataFrame:
    """Fill nulls of ``col`` with the exact median of ``col`` in ``fit_on``
    (default: ``df`` itself)."""
    src = df if fit_on is None else fit_on
    from .prefix import percentile_row, with_scalars
    out = with_scalars(df, percentile_row(src, col, {"_median": 0.5}))
    return out.withColumn(name or col, F.coalesce(F.col(col), F.col("_median"))).drop("_median")


# E3 -------------------------------------------------------------------------
def baseline_report(test: DataFrame, y: str = "units_sold", model_col: str | None = "y_pred",
                    lag_col: str = "lag_1", rolling_col: str = "rolling_mean_4") -> DataFrame:
    """lag_1 (nulls -> the test median of lag_1) and rolling-mean baselines,
    plus the model; improvement % of each against the lag_1 baseline."""
    t = fill_median(test, lag_col, name="_lag_filled")
    preds = {"lag_1": "_lag_filled", "rolling_mean_4": rolling_col}
    if model_col:
        preds["model"] = model_col
    m = regression_metrics(t, y, preds)
    base = m.where(F.col("model") == "lag_1").select(F.col("wape").alias("_base"))
    from .prefix import with_scalars
    return (with_scalars(m, base)
            .select("*", (F.lit(100.0) * (F.col("_base") - F.col("wape")) / F.col("_base"))
                    .alias("improvement_pct")).drop("_base"))


# E4 / E5 / E8 helpers ----------------------------------------------------------
def score_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row per distinct score: positives and negatives at that score."""
    yy = F.col(y).cast("long")
    return (df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
              .groupBy(F.col(p).cast("double").alias("score"))
              .agg(F.sum(yy).alias("pos"), F.sum(F.lit(1) - yy).alias("neg")))


def roc_auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """Tie-aware ROC-AUC = Σ_s pos_s (N_below + neg_s / 2) / (P N)."""
    cum = running_totals(score_counts(df, y, p), ["score"], ["pos", "neg"])
    return cum.agg(F.try_divide(
        F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / F.lit(2.0))),
        F.max(F.col("total_pos")) * F.max(F.col("total_neg"))).alias("roc_auc"))


def average_precision(df: DataFrame, y: str, p: str) -> DataFrame:
    """Step-wise average precision: Σ_s (pos_s / P) x precision at
    threshold s (thresholds = distinct scores, descending)."""
    cum = running_totals(score_counts(df, y, p), [("score", False)], ["pos", "neg"])
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return cum.agg(F.try_divide(F.sum(F.col("pos") * prec), F.max("total_pos")).alias("average_precision"))


def _desc_points(df: DataFrame, y: str, p: str) -> DataFrame:
    """Distinct scores in descending order with their global rank and
    inclusive cumulative positive / negative counts, and the next score's counts."""
    sc = score_counts(df, y, p).withColumn("_one", F.lit(1).cast("long"))
    cum = running_totals(sc, [("score", False)], ["pos", "neg", "_one"], following=True)
    return cum.select("score", "pos", "neg", F.col("cum__one").alias("rank"), "cum_pos", "cum_neg", "total_pos", "total_neg",
                      F.col("total__one").alias("n_points"), "next_pos", "next_neg")


def roc_points(df: DataFrame, y: str, p: str, drop_intermediate: bool = True) -> DataFrame:
    """ROC curve (threshold, fpr, tpr): a (0, 0) start point (threshold
    null, i.e. above every score), then one point per distinct score in
    descending order. With ``drop_intermediate`` a point is kept only when
    it is the first or last, or when the next score's positive / negative
    counts differ from its own (otherwise it lies on a straight segment).
    The next score's counts come with the ranked scores, without a join on
    the rank."""
    pts = _desc_points(df, y, p)
    if drop_intermediate:
        pts = pts.where((F.col("rank") == 1) | (F.col("rank") == F.col("n_points"))
                        | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg")))
    curve = pts.select(F.col("score").alias("threshold"),
                       F.try_divide(F.col("cum_neg"), F.col("total_neg")).alias("fpr"),
                       F.try_divide(F.col("cum_pos"), F.col("total_pos")).alias("tpr"))
    start = pts.agg(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"),
                    F.lit(0.0).alias("tpr"))
    return start.unionByName(curve)


def pr_points(df: DataFrame, y: str, p: str) -> DataFrame:
    """Precision-recall curve (threshold, precision, recall): distinct
    scores from the highest down to the first one reaching full recall,
    then the end point (precision 1, recall 0, threshold null)."""
    pts = _desc_points(df, y, p).where(F.col("cum_pos") - F.col("pos") < F.col("total_pos"))
    curve = pts.select(F.col("score").alias("threshold"),
                       (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
                       F.try_divide(F.col("cum_pos"), F.col("total_pos")).alias("recall"))
    end = pts.agg(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                  F.lit(0.0).alias("recall"))
    return curve.unionByName(end)


# E6 -------------------------------------------------------------------------
def prob_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    d = F.col(p) - F.col(y).cast("double")
    return df.agg(F.avg(d * d).alias("brier_score"), F.avg(F.col(y).cast("double")).alias("positive_rate"),
                  F.count(F.lit(1)).alias("n"))


def classifier_summary(df: DataFrame, y: str, p: str) -> DataFrame:
    """ROC-AUC, average precision, Brier score, positive rate and n in one
    row, all from one pass over the rows: per-score positive / negative
    counts, one ascending running total (descending counts are
    total - ascending + own), and Brier = Σ pos·(s-1)² + neg·s² over them."""
    cum = running_totals(score_counts(df, y, p), ["score"], ["pos", "neg"])
    P_, N_ = F.max("total_pos"), F.max("total_neg")
    desc_pos = F.col("total_pos") - F.col("cum_pos") + F.col("pos")
    desc_neg = F.col("total_neg") - F.col("cum_neg") + F.col("neg")
    sc = F.col("score")
    return cum.agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / F.lit(2.0))),
                     P_ * N_).alias("roc_auc"),
        F.try_divide(F.sum(F.col("pos") * desc_pos / (desc_pos + desc_neg)), P_).alias("average_precision"),
        (F.sum(F.col("pos") * (sc - 1) * (sc - 1) + F.col("neg") * sc * sc) / (P_ + N_)).alias("brier_score"),
        (P_ / (P_ + N_)).alias("positive_rate"),
        (P_ + N_).alias("n"))


# E7 -------------------------------------------------------------------------
def classification_report(df: DataFrame, y: str, p: str, threshold: float = 0.5) -> DataFrame:
    """Per-class precision / recall / F1 / support, accuracy, macro and
    weighted averages at ``p > threshold`` (0 where a ratio is undefined)."""
    pred = (F.col(p) > F.lit(threshold)).cast("int")
    yy = F.col(y).cast("int")
    c = df.agg(F.count_if((pred == 1) & (yy == 1)).alias("tp"), F.count_if((pred == 1) & (yy == 0)).alias("fp"),
               F.count_if((pred == 0) & (yy == 1)).alias("fn"), F.count_if((pred == 0) & (yy == 0)).alias("tn"))

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    p1, r1 = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    p0, r0 = ratio(F.col("tn"), F.col("tn") + F.col("fn")), ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    f1 = ratio(2 * p1 * r1, p1 + r1)
    f0 = ratio(2 * p0 * r0, p0 + r0)
    s1, s0 = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    n = s0 + s1
    acc = ratio(F.col("tp") + F.col("tn"), n)
    w = lambda a, b: ratio(a * s0 + b * s1, n)
    rows = F.array(
        F.struct(F.lit("0").alias("label"), p0.alias("precision"), r0.alias("recall"), f0.alias("f1"), s0.alias("support")),
        F.struct(F.lit("1").alias("label"), p1.alias("precision"), r1.alias("recall"), f1.alias("f1"), s1.alias("support")),
        F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), acc.alias("f1"), n.alias("support")),
        F.struct(F.lit("macro avg").alias("label"), ((p0 + p1) / 2).alias("precision"), ((r0 + r1) / 2).alias("recall"),
                 ((f0 + f1) / 2).alias("f1"), n.alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), w(p0, p1).alias("precision"), w(r0, r1).alias("recall"),
                 w(f0, f1).alias("f1"), n.alias("support")))
    return c.select(F.explode(rows).alias("_r")).select("_r.*")


# E9 -------------------------------------------------------------------------
def calibration_curve(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Uniform right-closed bins on [0, 1] (0 joins the first); empty bins
    are absent. mean predicted, observed rate, n per bin."""
    b = F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil(F.col(p) * F.lit(bins)).cast("int")))
    return (df.where(F.col(p).isNotNull()).groupBy(b.alias("bin"))
              .agg(F.avg(p).alias("prob_pred"), F.avg(F.col(y).cast("double")).alias("prob_true"),
                   F.count(F.lit(1)).alias("n")))


def error_columns(df: DataFrame, y: str = "units_sold", yhat: str = "y_pred") -> DataFrame:
    """C17: error = ŷ - y and its absolute value."""
    return df.withColumn("error", F.col(yhat) - F.col(y)).withColumn("abs_error", F.abs(F.col("error")))


def winsorize(df: DataFrame, col: str, lo: float = 0.01, hi: float = 0.99,
              name: str | None = None) -> DataFrame:
    """Clip ``col`` to its own exact lo / hi quantiles."""
    from .prefix import percentile_row, with_scalars
    q = percentile_row(df, col, {"_qlo": lo, "_qhi": hi})
    out = with_scalars(df, q)
    return out.withColumn(name or col, F.least(F.greatest(F.col(col), F.col("_qlo")), F.col("_qhi"))) \
              .drop("_qlo", "_qhi")


def clip_to_train_range(pred: DataFrame, train: DataFrame, col: str = "y_pred",
                        target: str = "units_sold", q: float = 0.999, factor: float = 2.0) -> DataFrame:
    """Clip predictions to [0, factor x the train target's q-quantile]."""
    from .prefix import percentile_row, with_scalars
    cap = percentile_row(train, target, {"_cap": q})
    out = with_scalars(pred, cap)
    return out.withColumn(col, F.least(F.greatest(F.col(col), F.lit(0.0)),
                                       F.lit(float(factor)) * F.col("_cap"))).drop("_cap")


def metric_rows(metrics: Sequence[tuple[str, Column]], df: DataFrame) -> DataFrame:
    """Long (metric, value) rows from one aggregate pass."""
    one = df.agg(*[c.alias(n) for n, c in metrics])
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
                     for n, _ in metrics])
    return one.select(F.explode(rows).alias("_r")).select("_r.*")
