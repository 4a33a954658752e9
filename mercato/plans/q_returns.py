"""Registered queries: return labels and classifier evaluation
(C9-C15, W4, J3, A6-A8, A15, A16, A19, C19, K1, K2, E4-E9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..functions.random import sql_normal, sql_uniform
from ..operators import aggregates as A
from ..operators import evaluation as E
from ..operators import topk as K
from ..sources.standin import Inputs, sql_with
from . import returns as RT
from .catalog import R, query
from .stage_jobs import Stages

VE = P.STANDIN_VAL_END
TE = P.STANDIN_TRAIN_END
LP = P.ReturnLabelParams()


def _rates_sql(col):
    cases = " ".join(f"WHEN '{k}' THEN CAST({v!r} AS DOUBLE)" for k, v in LP.rates.items())
    return f"CASE {col} {cases} ELSE CAST({LP.default_rate!r} AS DOUBLE) END"


LT_BODY = f""",
lt0 AS (SELECT t.*, {", ".join("a." + c for c in RT.ATTRS)}, c.age, c.club_member_status, c.fashion_news_frequency
        FROM transactions_c t LEFT JOIN articles a ON t.article_id = a.article_id
        LEFT JOIN customers c ON t.customer_id = c.customer_id
        WHERE a.product_group_name IS NOT NULL),
med AS (SELECT product_group_name, quantile_cont(price, 0.5) AS price_median_group FROM lt0 GROUP BY 1),
lt1 AS (SELECT lt0.*, med.price_median_group, {_rates_sql('lt0.product_group_name')} AS base_rate,
               CASE WHEN price > med.price_median_group THEN CAST(1.15 AS DOUBLE) ELSE CAST(0.95 AS DOUBLE) END AS price_factor,
               CASE WHEN fashion_news_frequency IN ('Regularly', 'Monthly') THEN CAST(0.85 AS DOUBLE)
                    ELSE CAST(1.05 AS DOUBLE) END AS customer_factor
        FROM lt0 LEFT JOIN med ON lt0.product_group_name = med.product_group_name),
lt2 AS (SELECT *, least(greatest(base_rate * price_factor * customer_factor, 0.01::DOUBLE), 0.95::DOUBLE) AS return_prob_clean FROM lt1),
lt3 AS (SELECT *, least(greatest(return_prob_clean + {sql_normal(['tx_key'], f'noise:{LP.seed}', 0.0, LP.noise_std)}, 0.01::DOUBLE), 0.95::DOUBLE) AS return_prob FROM lt2),
lt AS (SELECT * EXCLUDE (returned), returned AS returned_flag,
              CAST({sql_uniform(['tx_key'], f'label:{LP.seed}')} < return_prob AS INTEGER) AS returned FROM lt3),
test AS (SELECT * FROM lt WHERE t_dat > DATE '{VE}')"""
LT_CTE = sql_with("transactions_c", "articles", "customers") + LT_BODY


def _lt(spark, sf_dir, *cols):
    """Labelled transactions with ``cols``."""
    inp = Inputs(spark, sf_dir)
    return RT.labelled_transactions(inp.customer_transactions(), inp.articles(), inp.customers(), LP, cols=cols)


def _test(spark, sf_dir):
    return _lt(spark, sf_dir, "t_dat").where(F.col("t_dat") > F.lit(VE).cast("date"))


@query("return_labels", LT_CTE + f"""
SELECT tx_key, product_group_name, {R('base_rate')} AS base_rate, {R('price_median_group')} AS price_median_group,
       {R('price_factor')} AS price_factor, {R('customer_factor')} AS customer_factor,
       {R('return_prob_clean')} AS return_prob_clean, {R('return_prob')} AS return_prob, returned, returned_flag
FROM lt""")
def q_return_labels(spark, sf_dir):
    """J1 + J3 + F1 + C9-C13 + W4: labelled transactions."""
    return _lt(spark, sf_dir).select("tx_key", "product_group_name", "base_rate", "price_median_group",
                                     "price_factor", "customer_factor", "return_prob_clean",
                                     "return_prob", "returned", "returned_flag")


@query("return_features", LT_CTE + f""",
am AS (SELECT quantile_cont(age, 0.5) AS m FROM lt)
SELECT tx_key, {", ".join(f"coalesce({c}, 'Unknown') AS {c}" for c in P.RETURN_CAT_FEATURES)},
       {R('coalesce(age, (SELECT m FROM am))')} AS age, {R('price')} AS price,
       CAST(isodow(t_dat) - 1 AS INTEGER) AS day_of_week, CAST(month(t_dat) AS INTEGER) AS month, returned
FROM lt""")
def q_return_features(spark, sf_dir):
    """C14 + C15 + C4: the returns model's 12 features."""
    f = RT.return_features(_lt(spark, sf_dir, "t_dat", "age", *P.RETURN_CAT_FEATURES))
    return f.select("tx_key", *P.RETURN_CAT_FEATURES, "age", "price", "day_of_week", "month", "returned")


@query("return_rate_by_group", LT_CTE + f"""
SELECT product_group_name, {R('avg(CAST(returned AS DOUBLE))')} AS return_rate, count(*) AS n_transactions
FROM lt GROUP BY 1""")
def q_return_rate_by_group(spark, sf_dir):
    """Synthetic return rate and n per product group."""
    return A.return_rate_by(_lt(spark, sf_dir), "product_group_name")


@query("base_rate_counts", LT_CTE + f"""
SELECT {R('base_rate')} AS base_rate, count(*) AS count FROM lt GROUP BY 1""")
def q_base_rate_counts(spark, sf_dir):
    """Value counts of the base rate."""
    return A.value_counts(_lt(spark, sf_dir), "base_rate")


@query("returns_split_profile", LT_CTE + f"""
SELECT CASE WHEN t_dat <= DATE '{TE}' THEN 'train' WHEN t_dat <= DATE '{VE}' THEN 'val' ELSE 'test' END AS split,
       count(*) AS n_rows, min(t_dat) AS min_week, max(t_dat) AS max_week,
       {R('avg(CAST(returned AS DOUBLE))')} AS positive_rate
FROM lt GROUP BY 1""")
def q_returns_split_profile(spark, sf_dir):
    """F5 + A19: rows, date range and positive rate per split."""
    from ..operators import filters as Fi
    s = Fi.with_split(_lt(spark, sf_dir, "t_dat"), "t_dat", TE, VE)
    return A.split_profile(s, "split", "t_dat", "returned")


SQL_RISK = """SELECT article_id, avg(return_prob_clean) AS avg_return_prob,
         avg(CAST(returned_flag AS DOUBLE)) AS actual_return_rate, count(*) AS n_transactions
  FROM test GROUP BY 1"""


@query("article_return_risk", LT_CTE + f""",
r AS ({SQL_RISK})
SELECT article_id, {R('avg_return_prob')} AS avg_return_prob, {R('actual_return_rate')} AS actual_return_rate,
       n_transactions FROM r""")
def q_article_return_risk(spark, sf_dir):
    """Per-article mean predicted probability, observed rate, n (test period)."""
    return Stages(spark, sf_dir).return_predictions()


@query("risk_tiers", LT_CTE + f""",
r AS ({SQL_RISK}),
t AS (SELECT CASE WHEN avg_return_prob < 0.15 THEN 'low' WHEN avg_return_prob < 0.30 THEN 'mid' ELSE 'high' END AS tier FROM r),
tiers AS (SELECT unnest(['low', 'mid', 'high']) AS tier)
SELECT tiers.tier, count(t.tier) AS n, {R('100.0 * count(t.tier) / (SELECT count(*) FROM r)')} AS pct
FROM tiers LEFT JOIN t ON tiers.tier = t.tier GROUP BY 1""")
def q_risk_tiers(spark, sf_dir):
    """C19 + A15: low / mid / high risk tier counts and shares."""
    return A.risk_tiers(Stages(spark, sf_dir).return_predictions())


@query("article_calibration", LT_CTE + f""",
r AS ({SQL_RISK}),
b AS (SELECT * FROM r WHERE n_transactions >= 5),
q AS (SELECT quantile_cont(avg_return_prob, 0.99) AS p99 FROM b),
x AS (SELECT b.*, least(10, greatest(1, CAST(ceil(avg_return_prob / (q.p99 / 10.0)) AS INTEGER))) AS bin
      FROM b, q WHERE avg_return_prob >= 0 AND avg_return_prob <= q.p99)
SELECT bin, {R('avg(avg_return_prob)')} AS pred_mean, {R('avg(actual_return_rate)')} AS actual_mean, count(*) AS n
FROM x GROUP BY 1 HAVING count(*) >= 10""")
def q_article_calibration(spark, sf_dir):
    """A16 + K2: article calibration in right-closed bins up to p99."""
    return A.article_calibration(Stages(spark, sf_dir).return_predictions())


@query("risk_histogram", LT_CTE + """,
r AS (SELECT article_id, avg(return_prob_clean) AS avg_return_prob FROM test GROUP BY 1),
m AS (SELECT min(avg_return_prob) AS lo, max(avg_return_prob) AS hi FROM r)
SELECT CASE WHEN hi = lo THEN 1 ELSE least(40, CAST(floor((avg_return_prob - lo) / (hi - lo) * 40.0) AS INTEGER) + 1) END AS bin,
       count(*) AS count FROM r, m GROUP BY 1""")
def q_risk_histogram(spark, sf_dir):
    """K1: 40 equal-width bins of article risk over its range."""
    from ..functions import columns as C
    from ..operators.prefix import with_scalars
    r = Stages(spark, sf_dir).return_predictions()
    mm = r.agg(F.min("avg_return_prob").alias("_lo"), F.max("avg_return_prob").alias("_hi"))
    x = with_scalars(r, mm)
    return (x.select(C.equal_width_bin("avg_return_prob", F.col("_lo"), F.col("_hi"), 40).alias("bin"))
             .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))


@query("classifier_metrics", LT_CTE + f""",
s AS (SELECT return_prob_clean AS score, sum(returned) AS pos, sum(1 - returned) AS neg FROM test GROUP BY 1),
a AS (SELECT *, sum(neg) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS cneg_up FROM s),
d AS (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cpos,
             sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cneg FROM s)
SELECT {R('(SELECT sum(pos * (cneg_up - neg + neg / 2.0)) / (sum(pos) * sum(neg)) FROM a)')} AS roc_auc,
       {R('(SELECT sum(pos * cpos / (cpos + cneg)) / sum(pos) FROM d)')} AS average_precision,
       {R('avg((return_prob_clean - returned) * (return_prob_clean - returned))')} AS brier_score,
       {R('avg(CAST(returned AS DOUBLE))')} AS positive_rate, count(*) AS n
FROM test""")
def q_classifier_metrics(spark, sf_dir):
    """E4 + E5 + E6: tie-aware ROC-AUC, average precision, Brier, positive rate."""
    return E.classifier_summary(_test(spark, sf_dir), "returned", "return_prob_clean")


@query("classification_report", LT_CTE + f""",
c AS (SELECT count(*) FILTER (WHERE return_prob_clean > 0.5 AND returned = 1) AS tp,
             count(*) FILTER (WHERE return_prob_clean > 0.5 AND returned = 0) AS fp,
             count(*) FILTER (WHERE return_prob_clean <= 0.5 AND returned = 1) AS fn,
             count(*) FILTER (WHERE return_prob_clean <= 0.5 AND returned = 0) AS tn FROM test),
k AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r1,
             coalesce(tn / nullif(tn + fn, 0), 0.0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0.0) AS r0,
             tp + fn AS s1, tn + fp AS s0 FROM c),
f AS (SELECT *, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0.0) AS f1, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0.0) AS f0,
             s0 + s1 AS n FROM k)
SELECT '0' AS label, {R('p0')} AS precision, {R('r0')} AS recall, {R('f0')} AS f1, s0 AS support FROM f
UNION ALL SELECT '1', {R('p1')}, {R('r1')}, {R('f1')}, s1 FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, {R('(tp + tn) / n')}, n FROM f
UNION ALL SELECT 'macro avg', {R('(p0 + p1) / 2')}, {R('(r0 + r1) / 2')}, {R('(f0 + f1) / 2')}, n FROM f
UNION ALL SELECT 'weighted avg', {R('(p0 * s0 + p1 * s1) / n')}, {R('(r0 * s0 + r1 * s1) / n')},
                 {R('(f0 * s0 + f1 * s1) / n')}, n FROM f""")
def q_classification_report(spark, sf_dir):
    """Per-class report at p > 0.5."""
    return E.classification_report(_test(spark, sf_dir), "returned", "return_prob_clean", 0.5)


@query("roc_points", LT_CTE + f""",
s AS (SELECT return_prob_clean AS score, sum(returned) AS pos, sum(1 - returned) AS neg FROM test GROUP BY 1),
d AS (SELECT score, pos, neg, row_number() OVER (ORDER BY score DESC) AS rk,
             sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cpos,
             sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cneg,
             lead(pos) OVER (ORDER BY score DESC) AS npos, lead(neg) OVER (ORDER BY score DESC) AS nneg,
             sum(pos) OVER () AS tp, sum(neg) OVER () AS tn, count(*) OVER () AS n FROM s)
SELECT CAST(NULL AS DOUBLE) AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL
SELECT {R('score')}, {R('cneg / tn')}, {R('cpos / tp')} FROM d
WHERE rk = 1 OR rk = n OR npos <> pos OR nneg <> neg""")
def q_roc_points(spark, sf_dir):
    """ROC curve points (start point, collinear points dropped)."""
    return E.roc_points(_test(spark, sf_dir), "returned", "return_prob_clean")


@query("pr_points", LT_CTE + f""",
s AS (SELECT return_prob_clean AS score, sum(returned) AS pos, sum(1 - returned) AS neg FROM test GROUP BY 1),
d AS (SELECT score, pos, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cpos,
             sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cneg, sum(pos) OVER () AS tp FROM s)
SELECT {R('score')} AS threshold, {R('cpos / (cpos + cneg)')} AS precision, {R('cpos / tp')} AS recall
FROM d WHERE cpos - pos < tp
UNION ALL SELECT CAST(NULL AS DOUBLE), 1.0::DOUBLE, 0.0::DOUBLE""")
def q_pr_points(spark, sf_dir):
    """Precision-recall points down to full recall, plus the end point."""
    return E.pr_points(_test(spark, sf_dir), "returned", "return_prob_clean")


@query("calibration_curve", LT_CTE + f"""
SELECT least(10, greatest(1, CAST(ceil(return_prob * 10.0) AS INTEGER))) AS bin,
       {R('avg(return_prob)')} AS prob_pred, {R('avg(CAST(returned AS DOUBLE))')} AS prob_true, count(*) AS n
FROM test GROUP BY 1""")
def q_calibration_curve(spark, sf_dir):
    """Transaction calibration curve, 10 uniform right-closed bins."""
    return E.calibration_curve(_test(spark, sf_dir), "returned", "return_prob", 10)


@query("top_risk", LT_CTE + f""",
r AS ({SQL_RISK})
SELECT r.article_id, a.product_type_name, a.colour_group_name, a.garment_group_name, a.department_name,
       {R('avg_return_prob')} AS avg_return_prob, {R('actual_return_rate')} AS actual_return_rate, n_transactions
FROM (SELECT * FROM r ORDER BY avg_return_prob DESC, article_id LIMIT 50) r
LEFT JOIN articles a ON r.article_id = a.article_id""")
def q_top_risk(spark, sf_dir):
    """T-e + J7: 50 riskiest articles with attributes."""
    from ..operators import joins as J
    r = Stages(spark, sf_dir).return_predictions()
    top = K.top_k(r, 50, "avg_return_prob")
    return J.attach_after_topk(top, Inputs(spark, sf_dir).articles(),
                               ["product_type_name", "colour_group_name", "garment_group_name", "department_name"])
