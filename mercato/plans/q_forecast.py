"""Registered queries: forecast evaluation on the baseline predictions
(E1-E3, C7, C8, C15, C17, C18, K1, A17, A18, A20, A21, T-b, T-g, T-h, J7, C20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..functions import columns as C
from ..operators import aggregates as A
from ..operators import evaluation as E
from ..operators import joins as J
from ..operators import topk as K
from ..sources.standin import Inputs, sql_with
from .catalog import R, query
from .forecast import baseline_predictions
from .q_features import SQL_LAGS, SQL_WEEKLY

VE = P.STANDIN_VAL_END
TE = P.STANDIN_TRAIN_END

PRED_BODY = f""",
weekly AS ({SQL_WEEKLY}), f AS ({SQL_LAGS}),
pred AS (SELECT article_id, week, units_sold, avg_price, lag_1, rolling_mean_4, rolling_mean_4 AS y_pred
         FROM f WHERE week > DATE '{VE}' AND lag_4 IS NOT NULL)"""
PRED_CTE = sql_with("transactions", "articles") + PRED_BODY


def _pred(spark, sf_dir):
    return baseline_predictions(Inputs(spark, sf_dir).transactions(), VE)


def _metric_sql(name, col):
    return (f"SELECT '{name}' AS model, sum(abs({col} - units_sold)) / sum(abs(units_sold)) AS wape, "
            f"avg(abs({col} - units_sold)) AS mae, sqrt(avg(({col} - units_sold) * ({col} - units_sold))) AS rmse, "
            f"count(*) AS n FROM t")


@query("baseline_report", PRED_CTE + f""",
t AS (SELECT *, coalesce(lag_1, (SELECT quantile_cont(lag_1, 0.5) FROM pred)) AS lag_f FROM pred),
m AS ({_metric_sql('lag_1', 'lag_f')} UNION ALL {_metric_sql('rolling_mean_4', 'rolling_mean_4')}
      UNION ALL {_metric_sql('model', 'y_pred')})
SELECT model, {R('wape')} AS wape, {R('mae')} AS mae, {R('rmse')} AS rmse, n,
       {R("100.0 * ((SELECT wape FROM m WHERE model = 'lag_1') - wape) / (SELECT wape FROM m WHERE model = 'lag_1')")} AS improvement_pct
FROM m""")
def q_baseline_report(spark, sf_dir):
    """E1 + E2 + E3 + C15: WAPE / MAE / RMSE of lag_1 (median-filled),
    rolling_mean_4 and the model; improvement over lag_1."""
    return E.baseline_report(_pred(spark, sf_dir))


@query("forecast_kpis", PRED_CTE + f"""
SELECT count(DISTINCT article_id) AS n_articles, count(*) AS n_predictions,
       {R('avg(y_pred - units_sold)')} AS bias,
       {R('sum(abs(y_pred - units_sold)) / sum(abs(units_sold))')} AS wape FROM pred""")
def q_forecast_kpis(spark, sf_dir):
    """A21 + E1: articles, predictions, bias, global WAPE."""
    return A.forecast_kpis(_pred(spark, sf_dir))


SQL_SUMMARY = """SELECT article_id, count(week) AS n_weeks, CAST(sum(units_sold) AS BIGINT) AS total_sold,
       sum(abs(y_pred - units_sold)) / sum(abs(units_sold)) AS wape FROM pred GROUP BY 1"""


@query("article_forecast_summary", PRED_CTE + f""",
s AS ({SQL_SUMMARY})
SELECT article_id, n_weeks, total_sold, {R('wape')} AS wape FROM s""")
def q_article_forecast_summary(spark, sf_dir):
    """Per-article weeks, units and WAPE."""
    return A.article_forecast_summary(_pred(spark, sf_dir))


@query("product_kpis", PRED_CTE + f"""
SELECT article_id,
       {R('CASE WHEN sum(units_sold) > 0 THEN sum(abs(y_pred - units_sold)) / sum(abs(units_sold)) ELSE 0.0 END')} AS wape,
       CAST(sum(units_sold) AS BIGINT) AS total_sold, CAST(trunc(sum(y_pred)) AS BIGINT) AS total_pred,
       CAST(trunc(sum(y_pred)) AS BIGINT) - CAST(sum(units_sold) AS BIGINT) AS diff
FROM pred GROUP BY 1""")
def q_product_kpis(spark, sf_dir):
    """Every product's WAPE (0 if nothing sold), units sold / predicted, difference."""
    return A.product_kpis(_pred(spark, sf_dir))


@query("top_article_series", PRED_CTE + f""",
top AS (SELECT article_id FROM pred GROUP BY 1 ORDER BY sum(units_sold) DESC, article_id LIMIT 6)
SELECT article_id, week, units_sold, {R('y_pred')} AS y_pred FROM pred WHERE article_id IN (SELECT article_id FROM top)""")
def q_top_article_series(spark, sf_dir):
    """T-b: weekly actual vs predicted for the 6 best-selling articles."""
    p = _pred(spark, sf_dir).select("article_id", "week", "units_sold", "y_pred")
    return K.top_article_series(p, 6)


@query("best_sellers", PRED_CTE + f""",
s AS ({SQL_SUMMARY}),
top AS (SELECT * FROM s ORDER BY total_sold DESC, article_id LIMIT 200)
SELECT top.article_id, n_weeks, total_sold, {R('wape')} AS wape, a.product_type_name, a.colour_group_name,
       concat_ws('  ·  ', top.article_id, coalesce(a.product_type_name, '?'), coalesce(a.colour_group_name, '?')) AS label
FROM top LEFT JOIN articles a ON top.article_id = a.article_id""")
def q_best_sellers(spark, sf_dir):
    """T-g + J7 + C20: 200 best sellers of the prediction period with
    attributes joined after the limit, and their selector label."""
    return _best_sellers(spark, sf_dir)


def _best_sellers(spark, sf_dir):
    inp = Inputs(spark, sf_dir)
    s = A.article_forecast_summary(_pred(spark, sf_dir))
    top = K.top_k(s, 200, "total_sold")
    out = J.attach_after_topk(top, inp.articles(), ["product_type_name", "colour_group_name"])
    return out.withColumn("label", C.product_label("article_id", "product_type_name", "colour_group_name"))


@query("label_to_id", PRED_CTE + f""",
s AS ({SQL_SUMMARY}),
top AS (SELECT * FROM s ORDER BY total_sold DESC, article_id LIMIT 200),
l AS (SELECT concat_ws('  ·  ', top.article_id, coalesce(a.product_type_name, '?'), coalesce(a.colour_group_name, '?')) AS label
      FROM top LEFT JOIN articles a ON top.article_id = a.article_id)
SELECT label, split_part(label, '  ·  ', 1) AS article_id FROM l""")
def q_label_to_id(spark, sf_dir):
    """C20: split a selector label back to its article id."""
    return _best_sellers(spark, sf_dir).select("label", C.label_to_id("label").alias("article_id"))


ATTRS_T_H = ["product_type_name", "colour_group_name", "garment_group_name", "department_name"]


@query("worst_forecasts", PRED_CTE + f""",
s AS ({SQL_SUMMARY}),
top AS (SELECT * FROM s WHERE n_weeks >= 4 ORDER BY wape DESC, article_id LIMIT 20)
SELECT top.article_id, n_weeks, total_sold, {R('wape')} AS wape, {", ".join("a." + c for c in ATTRS_T_H)}
FROM top LEFT JOIN articles a ON top.article_id = a.article_id""")
def q_worst_forecasts(spark, sf_dir):
    """T-h + F7 + J7: 20 worst-forecast articles with >= 4 weeks."""
    return _worst_forecasts(spark, sf_dir)


def _worst_forecasts(spark, sf_dir):
    inp = Inputs(spark, sf_dir)
    s = A.article_forecast_summary(_pred(spark, sf_dir)).where(F.col("n_weeks") >= 4)
    return J.attach_after_topk(K.top_k(s, 20, "wape"), inp.articles(), ATTRS_T_H)


@query("worst_forecasts_export", PRED_CTE + f""",
s AS ({SQL_SUMMARY}),
top AS (SELECT * FROM s WHERE n_weeks >= 4 ORDER BY wape DESC, article_id LIMIT 20)
SELECT top.article_id AS "Article ID", a.product_type_name AS "Product type", a.colour_group_name AS "Color",
       a.garment_group_name AS "Garment", n_weeks AS "N weeks", CAST(total_sold AS BIGINT) AS "Vendido",
       round_even(wape, 3) AS "WAPE"
FROM top LEFT JOIN articles a ON top.article_id = a.article_id""")
def q_worst_forecasts_export(spark, sf_dir):
    """T-h + C21: the worst-forecast table as exported."""
    out = C.export_view(_worst_forecasts(spark, sf_dir),
                        {"article_id": "Article ID", "product_type_name": "Product type", "colour_group_name": "Color",
                         "garment_group_name": "Garment", "n_weeks": "N weeks", "total_sold": "Vendido"},
                        round_cols={"wape": ("WAPE", 3)})
    return out.withColumn("Vendido", F.col("Vendido").cast("long"))


@query("error_histogram", PRED_CTE + """,
e AS (SELECT y_pred - units_sold AS error FROM pred),
q AS (SELECT quantile_cont(error, 0.01) AS lo, quantile_cont(error, 0.99) AS hi FROM e),
w AS (SELECT least(greatest(error, lo), hi) AS x, lo, hi FROM e, q)
SELECT CASE WHEN hi = lo THEN 1 ELSE least(60, CAST(floor((x - lo) / (hi - lo) * 60.0) AS INTEGER) + 1) END AS bin,
       count(*) AS count FROM w GROUP BY 1""")
def q_error_histogram(spark, sf_dir):
    """C17 + C18 + K1: error winsorised at its q01/q99, 60 equal-width bins."""
    from ..operators.prefix import percentile_row, with_scalars
    e = E.error_columns(_pred(spark, sf_dir)).select("error")
    q = percentile_row(e, "error", {"_lo": 0.01, "_hi": 0.99})
    w = E.winsorize(e, "error", 0.01, 0.99, "x")
    w = with_scalars(w, q)
    return (w.select(C.equal_width_bin("x", F.col("_lo"), F.col("_hi"), 60).alias("bin"))
             .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))


@query("clip_predictions", PRED_CTE + f""",
cap AS (SELECT 2.0 * quantile_cont(units_sold, 0.999) AS c FROM weekly WHERE week <= DATE '{TE}')
SELECT article_id, week, {R('least(greatest(greatest(exp(ln(1 + y_pred)) - 1, 0.0), 0.0), (SELECT c FROM cap))')} AS y_pred
FROM pred""")
def q_clip_predictions(spark, sf_dir):
    """C6 + C7 + C8: log-scale prediction inverted (expm1, >= 0) and clipped
    to [0, 2 x p99.9 of the train target]."""
    tx = Inputs(spark, sf_dir).transactions()
    p = _pred(spark, sf_dir).select("article_id", "week", F.log1p("y_pred").alias("log_pred"))
    p = p.select("article_id", "week", C.invert_log("log_pred").alias("y_pred"))
    train = A.weekly_sales(tx).where(F.col("week") <= F.lit(TE).cast("date"))
    return E.clip_to_train_range(p, train)


@query("target_profile", sql_with("transactions") + f""",
weekly AS ({SQL_WEEKLY})
SELECT {R('avg(units_sold)')} AS mean, {R('quantile_cont(units_sold, 0.5)')} AS median,
       {R('max(units_sold)')} AS max, {R('quantile_cont(units_sold, 0.999)')} AS p999
FROM weekly WHERE week <= DATE '{TE}'""")
def q_target_profile(spark, sf_dir):
    """Train target mean, median, max, p99.9."""
    w = A.weekly_sales(Inputs(spark, sf_dir).transactions())
    return A.target_profile(w.where(F.col("week") <= F.lit(TE).cast("date")))
