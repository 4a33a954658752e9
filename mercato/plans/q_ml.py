"""Registered queries: MLlib jobs (M1-M17) and the SQL-checkable pieces
(M2 rare-category grouping, M3 dummy median)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..ml import clustering as CL
from ..ml import models as ML
from ..ml.preprocess import group_rare, style_vectors
from ..operators import aggregates as A
from ..operators import evaluation as E
from ..operators import filters as Fi
from ..operators import joins as J
from ..operators import topk as K
from ..sources.standin import Inputs, sql_with
from . import feature_store as FS
from .catalog import R, query
from .q_features import SQL_WEEKLY
from .stage_jobs import STYLE_COLS, Stages

TE, VE = P.STANDIN_TRAIN_END, P.STANDIN_VAL_END



def comparison_sets(spark, sf_dir, max_fit_rows: int | None = None):
    """The comparison study's data: row-lag features, rows with all lags,
    last 8 distinct weeks held out. Rare categories are left to the models,
    which group them by the training rows of each fold. ``max_fit_rows`` fits
    on a reproducible sample of so many training rows; all held-out rows are
    always scored."""
    inp = Inputs(spark, sf_dir)
    f = FS.lag_features(A.weekly_sales(inp.transactions()))
    f = Fi.drop_incomplete(f, ["lag_1", "lag_2", "lag_4", "rolling_mean_4"])
    f = J.enrich_articles(f.withColumn("month", F.month("week")).withColumn("week_of_year", F.weekofyear("week")),
                            inp.articles(), ML.DEMAND_CAT)
    s = Fi.with_holdout(f, P.HOLDOUT_WEEKS)
    if max_fit_rows is not None:
        fit = K.sample_n(s.where(F.col("split") == "train"), max_fit_rows, ["article_id", "week"], P.RANDOM_SEED)
        s = fit.unionByName(s.where(F.col("split") == "test"))
    s = s.cache()
    s.count()  # materialise once so model fit times exclude data preparation
    return s.where(F.col("split") == "train"), s.where(F.col("split") == "test")


@query("model_comparison")
def q_model_comparison(spark, sf_dir):
    """M1 + M2 + M3-M7 + M11: the five model families of the reference's
    study with its grids, compared with expanding time-fold grid search."""
    train, test = comparison_sets(spark, sf_dir)
    return ML.compare_models(ML.REFERENCE_CONFIGS, train, test)


@query("demand_model_predictions")
def q_demand_model_predictions(spark, sf_dir):
    """M8 + M10 + C7 + C8: boosted demand model (log target, native
    categoricals, early stopping on the validation weeks) scored on test."""
    return Stages(spark, sf_dir).demand_scores().select("article_id", "week", "units_sold", "y_pred", "avg_price")


@query("demand_model_metrics")
def q_demand_model_metrics(spark, sf_dir):
    """E2 + E3 on the model: WAPE / MAE / RMSE against the lag_1 and
    rolling-mean baselines and the improvement over lag_1."""
    return E.baseline_report(Stages(spark, sf_dir).demand_scores().select("units_sold", "lag_1", "rolling_mean_4", "y_pred"))


@query("small_demand_model_metrics")
def q_small_demand_model_metrics(spark, sf_dir):
    """M8 with 14 features + E2 + E3."""
    stages = Stages(spark, sf_dir)
    test = stages.demand_features().where(F.col("split") == "test")
    scored = ML.score_demand(stages.small_demand_model(), test, P.CATEGORY_COLS)
    return E.baseline_report(scored.select("units_sold", "lag_1", "rolling_mean_4", "y_pred"))


@query("feature_importance")
def q_feature_importance(spark, sf_dir):
    """Top 15 importances of the demand model with feature names."""
    stages = Stages(spark, sf_dir)
    train = stages.demand_features().where(F.col("split") == "train")
    return ML.feature_importance(stages.demand_model(), train.na.fill(P.MISSING_CATEGORY, subset=P.CATEGORY_COLS))


@query("return_feature_importance")
def q_return_feature_importance(spark, sf_dir):
    """M12 on the returns classifier."""
    stages = Stages(spark, sf_dir)
    return ML.feature_importance(stages.return_model(), stages.return_features().where(F.col("split") == "train"))


@query("model_roundtrip")
def q_model_roundtrip(spark, sf_dir):
    """The test rows scored with the published model as it is loaded."""
    stages = Stages(spark, sf_dir)
    stages.demand_model()
    loaded = stages.store.read_model("demand_model")
    test = stages.demand_features().where(F.col("split") == "test")
    return ML.score_demand(loaded, test, P.CATEGORY_COLS).select("article_id", "week", "y_pred")


@query("returns_model_metrics")
def q_returns_model_metrics(spark, sf_dir):
    """M9 + M10 + E4-E6: returns classifier on the test period — ROC-AUC,
    average precision, Brier score, positive rate."""
    return E.classifier_summary(Stages(spark, sf_dir).scored_transactions(), "returned", "return_prob_pred")


@query("returns_model_article_risk")
def q_returns_model_article_risk(spark, sf_dir):
    """M10 + A8: per-article predicted return probability from the model."""
    return Stages(spark, sf_dir).return_scores()


def _vecs(spark, sf_dir):
    vecs, _ = style_vectors(Inputs(spark, sf_dir).articles(), STYLE_COLS)
    return vecs.select("article_id", "features", *STYLE_COLS)


@query("k_sweep")
def q_k_sweep(spark, sf_dir):
    """M13 + M14: inertia and silhouette for k = 3..8."""
    return CL.k_sweep(_vecs(spark, sf_dir))


@query("style_clusters")
def q_style_clusters(spark, sf_dir):
    """M13 + M15: final k = 4 assignment, best of 10 starts."""
    return Stages(spark, sf_dir).article_clusters()


@query("style_cluster_profile")
def q_style_cluster_profile(spark, sf_dir):
    """A12 on the MLlib clusters: size and modal garment / index / colour /
    department per cluster."""
    df = Inputs(spark, sf_dir).articles().join(Stages(spark, sf_dir).article_clusters(), "article_id")
    return A.cluster_profile(df, "cluster", None, {"top_garment": "garment_group_name",
                                                   "top_index": "index_group_name",
                                                   "top_color": "colour_group_name",
                                                   "top_dept": "department_name"})


@query("pca_projection")
def q_pca_projection(spark, sf_dir):
    """2-D PCA of the style vectors with explained variance."""
    proj, var = CL.pca2(_vecs(spark, sf_dir).cache())
    return proj.withColumn("explained_var_1", F.lit(var[0])).withColumn("explained_var_2", F.lit(var[1]))


RARE_COLS = ML.DEMAND_CAT


def _rare_case(c):
    return (f"CASE WHEN coalesce(rc_{c}.n, 0) >= 50 THEN coalesce(w.{c}, 'missing') ELSE 'infrequent' END AS {c}")


@query("group_rare", sql_with("transactions", "articles") + f""",
weekly AS ({SQL_WEEKLY}),
w AS (SELECT weekly.article_id, week, {", ".join("a." + c for c in RARE_COLS)}
      FROM weekly LEFT JOIN articles a ON weekly.article_id = a.article_id),
{", ".join(f"rc_{c} AS (SELECT coalesce({c}, 'missing') AS v, count(*) AS n FROM w WHERE week <= DATE '{TE}' GROUP BY 1)" for c in RARE_COLS)}
SELECT w.article_id, w.week, {", ".join(_rare_case(c) for c in RARE_COLS)}
FROM w {" ".join(f"LEFT JOIN rc_{c} ON coalesce(w.{c}, 'missing') = rc_{c}.v" for c in RARE_COLS)}""")
def q_group_rare(spark, sf_dir):
    """M2 + C14: categories seen fewer than 50 times in train share one bucket."""
    inp = Inputs(spark, sf_dir)
    w = J.enrich_articles(A.weekly_sales(inp.transactions()), inp.articles(), RARE_COLS).select(
        "article_id", "week", *RARE_COLS)
    return group_rare(w.where(F.col("week") <= F.lit(TE).cast("date")), w, RARE_COLS, 50)


@query("dummy_median_metrics", sql_with("transactions") + f""",
weekly AS ({SQL_WEEKLY}),
m AS (SELECT quantile_cont(units_sold, 0.5) AS med FROM weekly WHERE week <= DATE '{TE}'),
t AS (SELECT units_sold, (SELECT med FROM m) AS y_pred FROM weekly WHERE week > DATE '{VE}')
SELECT 'dummy' AS model, {R('sum(abs(y_pred - units_sold)) / sum(abs(units_sold))')} AS wape,
       {R('avg(abs(y_pred - units_sold))')} AS mae, {R('sqrt(avg((y_pred - units_sold) * (y_pred - units_sold)))')} AS rmse,
       count(*) AS n FROM t""")
def q_dummy_median_metrics(spark, sf_dir):
    """M3 + E2: train-median predictor scored on the test weeks."""
    w = A.weekly_sales(Inputs(spark, sf_dir).transactions())
    train = w.where(F.col("week") <= F.lit(TE).cast("date"))
    test = w.where(F.col("week") > F.lit(VE).cast("date"))
    pred = ML.fit_predict(ML.ModelConfig("Dummy", "dummy"), {}, train, test)
    return E.regression_metrics(pred, "units_sold", {"dummy": "y_pred"})
