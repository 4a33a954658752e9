"""Demand regressors, returns classifier, time-fold grid
search, model comparison, importances and persistence."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import params as P
from ..functions import columns as C
from ..operators import evaluation as E
from ..session import stored
from . import boosting, ridge
from .preprocess import RareCategories, column_stages, vector_stages

DEMAND_NUM = ["avg_price", "lag_1", "lag_2", "lag_4", "rolling_mean_4", "week_of_year", "month"]
DEMAND_CAT = ["product_type_name", "product_group_name", "colour_group_name", "department_name",
              "index_group_name", "garment_group_name"]


@dataclass
class ModelConfig:
    name: str
    kind: str                      # dummy | ridge | forest | gbt | boosted
    grid: list = field(default_factory=lambda: [{}])
    log_target: bool = False
    fixed: dict = field(default_factory=dict)  # what a booster has at every point


# The reference's comparison study. One booster grows all leaves of a level
# and has an L2 penalty, the other grows the leaf of the largest gain until
# there are 31 / 63; rounds and grids are the reference's, the rest are those
# libraries' usual values.
REFERENCE_CONFIGS = [
    ModelConfig("Dummy", "dummy"),
    ModelConfig("Ridge", "ridge", [{"regParam": a} for a in (0.1, 1.0, 10.0)], True),
    ModelConfig("RandomForest", "forest", [{"numTrees": 100, "maxDepth": d} for d in (10, 20)], True),
    ModelConfig("XGBoost", "boosted", [{"depth": d, "step": s} for d in (6, 8) for s in (0.05, 0.1)],
                fixed={"rounds": 200, "leaf_rows": 1, "l2": 1.0}),
    ModelConfig("LightGBM", "boosted", [{"leaves": n, "step": s} for n in (31, 63) for s in (0.05, 0.1)],
                fixed={"rounds": 200, "leaf_rows": 20}),
]

# Four families with smaller forests and fewer rounds: what bench.py times, on
# a sample. The registered comparison is the study above.
COMPACT_CONFIGS = [
    ModelConfig("Dummy", "dummy"),
    ModelConfig("Ridge", "ridge", [{"regParam": a} for a in (0.1, 1.0, 10.0)], True),
    ModelConfig("RandomForest", "forest", [{"numTrees": 30, "maxDepth": d} for d in (6, 10)], True),
    ModelConfig("GBT", "gbt", [{"maxIter": 15, "maxDepth": 6, "stepSize": s} for s in (0.1, 0.3)]),
]


def _estimator(kind: str, params: Mapping, label: str, categories: int = 0, seed: int = 42):
    """``categories``: how many the largest nominal feature has; a tree needs
    as many bins."""
    if kind == "forest":
        return RandomForestRegressor(featuresCol="features", labelCol=label, seed=seed, maxBins=max(32, categories),
                                     cacheNodeIds=True, **params)
    if kind == "gbt":
        return GBTRegressor(featuresCol="features", labelCol=label, seed=seed, maxBins=max(64, categories), **params)
    raise ValueError(kind)


PIECE_ROWS = 1 << 21


def _pieces(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (``n`` of them) in a piece per core, more only where those
    would be large. In every task of a level a tree learner holds and sends the
    sums of all nodes, however few rows the task has."""
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // PIECE_ROWS)))


def _categories(vectors: DataFrame) -> int:
    """The size of the largest nominal feature of assembled vectors."""
    nominal = vectors.schema["features"].metadata.get("ml_attr", {}).get("attrs", {}).get("nominal", [])
    return max((len(a["vals"]) for a in nominal), default=0)


def _with_label(df: DataFrame, cfg: ModelConfig, target: str) -> DataFrame:
    y = F.col(target).cast("double")
    return df.withColumn("_label", F.log1p(y) if cfg.log_target else y)


def _prep(cfg: ModelConfig, train: DataFrame, num=DEMAND_NUM, cat=DEMAND_CAT, shared: dict | None = None,
          part=None) -> PipelineModel:
    """Fitted on ``train`` alone, the grouping of rare categories included.
    Ridge takes one-hot vectors, trees take the indexes as nominal features: a
    split on a nominal feature has the best gain of all its subsets, one
    category against the rest among them, and costs a tree one column instead
    of one per category. What the families have in common (frequent
    categories, medians, indexes) is kept in ``shared`` under ``part``, which
    names the training rows, so they are read for it once."""
    shared = {} if shared is None else shared
    known = shared.get(("columns", part))
    if known is None:
        known = shared["columns", part] = Pipeline(stages=[RareCategories(cat), *column_stages(num, cat)]).fit(train)
    linear = cfg.kind == "ridge"
    vector = Pipeline(stages=vector_stages(num, cat, scale=linear, one_hot=linear)).fit(known.transform(train))
    return PipelineModel(stages=[*known.stages, *vector.stages])


def _to_units(cfg: ModelConfig, df: DataFrame) -> DataFrame:
    pred = C.invert_log("prediction") if cfg.log_target else F.greatest(F.col("prediction"), F.lit(0.0))
    return df.withColumn("y_pred", pred)


def fit_predict(cfg: ModelConfig, params: Mapping, train: DataFrame, score: DataFrame,
                target: str = "units_sold", num=DEMAND_NUM, cat=DEMAND_CAT, shared: dict | None = None) -> DataFrame:
    """Fit one configuration on ``train`` and add ``y_pred`` (units, >= 0) to
    ``score``. Log-target models are inverted before scoring (C7)."""
    tr = _with_label(train, cfg, target)
    if cfg.kind == "dummy":
        from ..operators.prefix import percentile_row, with_scalars
        med = percentile_row(tr, "_label", {"y_pred": 0.5})
        return with_scalars(score, med)
    prep = _prep(cfg, tr, num, cat, shared, "all")
    if cfg.kind == "ridge":
        model = ridge.fit(prep.transform(tr), "_label", [params["regParam"]])[0]
    elif cfg.kind == "boosted":
        rows = prep.transform(tr).select("features", F.col("_label").alias("label"))
        model = boosting.boosters(rows, [{**cfg.fixed, **params}]).model(tr.sparkSession)
    else:
        rows = _pieces(prep.transform(tr).select("features", "_label"), tr.count())
        model = _estimator(cfg.kind, params, "_label", _categories(rows)).fit(rows)
    return _to_units(cfg, model.transform(prep.transform(score)))


# M7 -------------------------------------------------------------------------
class WapeEvaluator(Evaluator):
    """MLlib evaluator for WAPE = Σ|y - ŷ| / Σ|y| (smaller is better), one
    distributed aggregate per call."""

    def __init__(self, labelCol: str = "units_sold", predictionCol: str = "y_pred"):
        super().__init__()
        self.labelCol, self.predictionCol = labelCol, predictionCol

    def _evaluate(self, dataset: DataFrame) -> float:
        v = dataset.agg(E.wape(self.labelCol, self.predictionCol)).first()[0]
        return float("inf") if v is None else float(v)

    def isLargerBetter(self) -> bool:
        return False


def week_blocks(df: DataFrame, n_folds: int = 3, week: str = "week") -> DataFrame:
    """Assign each week to one of n_folds + 1 consecutive blocks of about
    equal row count (expanding-window folds cut on week boundaries). The
    per-week table has one row per week, so its window is bounded."""
    per_week = df.groupBy(week).agg(F.count(F.lit(1)).alias("_n"))
    w = W.orderBy(week)
    cum = per_week.select(week, "_n", (F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1))).alias("_before"),
                          F.sum("_n").over(W.partitionBy()).alias("_all"))
    blocks = cum.select(week, F.least(F.lit(n_folds), F.floor(
        F.coalesce(F.col("_before"), F.lit(0)) * F.lit(n_folds + 1) / F.col("_all")).cast("int")).alias("block"))
    return df.join(F.broadcast(blocks), week)


def grid_search(cfg: ModelConfig, train: DataFrame, n_folds: int = 3, target: str = "units_sold",
                parallelism: int = 4, shared: dict | None = None):
    """Mean WAPE (in units) over expanding time folds for each grid point;
    returns (best_params, best_cv_wape). The preprocessing is fitted once per
    fold on the fold's training rows (it does not depend on the grid). Ridge
    takes all its grid points from one pass over a fold, a booster's are one
    job of its own for each fold; those of the other families are fitted concurrently from driver threads, by fold and point,
    each fit being a distributed MLlib job. Searches over the same ``train``
    that are given one ``shared`` read the folds of the first; who made it
    drops them (:func:`drop_shared`)."""
    if cfg.kind == "dummy" or (len(cfg.grid) <= 1 and not cfg.grid[0]):
        return (cfg.grid[0] if cfg.grid else {}), None
    from concurrent.futures import ThreadPoolExecutor
    mine, shared = shared is None, {} if shared is None else shared
    if "blocked" not in shared:
        shared["rows"] = train.count()
        shared["blocked"] = _pieces(week_blocks(train, n_folds), shared["rows"]).cache()
    blocked = shared["blocked"]

    def fold(k):
        tr, va = blocked.where(F.col("block") <= k), blocked.where(F.col("block") == k + 1)
        prep = _prep(cfg, tr, shared=shared, part=k)
        return prep.transform(tr).select("features", target), prep.transform(va).select("features", target)

    def tree_fold(k):
        if ("vectors", k) not in shared:
            shared["vectors", k] = tuple(_pieces(rows, shared["rows"]).cache() for rows in fold(k))
        return shared["vectors", k]

    def ridge_scores(k):
        trx, vax = fold(k)
        names = []
        for i, model in enumerate(ridge.fit(_with_label(trx, cfg, target), "_label", [p["regParam"] for p in cfg.grid])):
            names.append(f"_y{i}")
            vax = _to_units(cfg, model.transform(vax)).withColumnRenamed("y_pred", names[-1]).drop("prediction")
        row = vax.agg(*[E.wape(target, c).alias(c) for c in names]).first()
        return [float("inf") if row[c] is None else row[c] for c in names]

    def boosted_scores(k):
        trx, vax = (rows.select("features", F.col(target).cast("double").alias("label")) for rows in tree_fold(k))
        if cfg.log_target:
            raise ValueError("boosters are judged in units")
        return boosting.boosters(trx, [{**cfg.fixed, **p} for p in cfg.grid]).wapes(vax)

    def tree_score(point):
        k, params = point
        trx, vax = folds[k]
        m = _estimator(cfg.kind, params, "_label", _categories(trx)).fit(_with_label(trx, cfg, target))
        return WapeEvaluator(target, "y_pred").evaluate(_to_units(cfg, m.transform(vax)))

    with ThreadPoolExecutor(max(1, parallelism)) as ex:
        if cfg.kind == "ridge":
            by_fold = list(ex.map(ridge_scores, range(n_folds)))
        elif cfg.kind == "boosted":
            by_fold = list(ex.map(boosted_scores, range(n_folds)))
        else:
            folds = list(ex.map(tree_fold, range(n_folds)))
            points = [(k, params) for k in reversed(range(n_folds)) for params in cfg.grid]  # the long ones first
            scores = list(ex.map(tree_score, points))
            by_fold = [scores[i:i + len(cfg.grid)] for i in range(0, len(scores), len(cfg.grid))]
    if mine:
        drop_shared(shared)
    cvs = [sum(s) / n_folds for s in zip(*by_fold)]
    i = min(range(len(cvs)), key=lambda j: cvs[j])
    return cfg.grid[i], cvs[i]


def drop_shared(shared: dict) -> None:
    """Free the tables that searches have kept in ``shared``."""
    for kept in shared.values():
        for rows in kept if isinstance(kept, tuple) else [kept]:
            if isinstance(rows, DataFrame):
                rows.unpersist()
    shared.clear()


# M11 ------------------------------------------------------------------------
def compare_models(configs: Sequence[ModelConfig], train: DataFrame, test: DataFrame,
                   target: str = "units_sold", clip_q: float = 0.999) -> DataFrame:
    """Fit every family (grid search on time folds, refit on all of train),
    score the test set (clipped to 2 x train p99.9), rank by test WAPE and
    report each model's gain over the dummy."""
    spark = train.sparkSession
    rows, shared = [], {}
    for cfg in configs:
        t0 = time.time()
        params, cv = grid_search(cfg, train, target=target, shared=shared)
        pred = fit_predict(cfg, params, train, test, target, shared=shared)
        pred = E.clip_to_train_range(pred, train, "y_pred", target, clip_q)
        m = pred.agg(E.wape(target, "y_pred").alias("w"),
                     F.sqrt(F.avg((F.col("y_pred") - F.col(target)) ** 2)).alias("r")).first()
        rows.append((cfg.name, cv, m["w"], m["r"], time.time() - t0, str(params)))
    drop_shared(shared)
    df = spark.createDataFrame(rows, "model string, cv_wape double, test_wape double, test_rmse double, "
                                     "fit_time_s double, best_params string")
    dummy = df.where(F.col("model") == "Dummy").select(F.col("test_wape").alias("_dw"))
    from ..operators.prefix import with_scalars
    return (with_scalars(df, dummy)
            .withColumn("gain_vs_dummy_pct", F.lit(100.0) * (F.col("_dw") - F.col("test_wape")) / F.col("_dw"))
            .withColumn("rank", F.row_number().over(W.orderBy("test_wape", "model"))).drop("_dw"))


# M8 -------------------------------------------------------------------------
def indexed(known: DataFrame, num: Sequence[str], cat: Sequence[str]) -> PipelineModel:
    """Categories indexed natively (nominal metadata) beside the numerics."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    idx = [f"_idx_{c}" for c in cat]
    return Pipeline(stages=[
        StringIndexer(inputCols=list(cat), outputCols=idx, handleInvalid="keep"),
        VectorAssembler(inputCols=[*num, *idx], outputCol="features", handleInvalid="keep"),
    ]).fit(known)


def train_demand(train_val: DataFrame, features_num: Sequence[str], features_cat: Sequence[str],
                 label: str = "log_units", depth: int = 6, **how) -> PipelineModel:
    """Boosted demand model on the log target with native categoricals: up to
    1,000 rounds, stopped after 50 without a smaller absolute error on the
    rows flagged ``is_val`` (:mod:`mercato.ml.boosting`; ``how`` goes there).
    63 leaves are a depth of 6."""
    data = train_val.na.fill(P.MISSING_CATEGORY, subset=list(features_cat))
    prep = indexed(data.where(~F.col("is_val")), features_num, features_cat)
    rows = stored(prep.transform(data).select("features", F.col(label).alias("label"), "is_val"), "vectors")
    made = boosting.boost(rows.where(~F.col("is_val")).drop("is_val"), rows.where("is_val").drop("is_val"),
                          depth=depth, **how)
    return PipelineModel(stages=[*prep.stages, made.model])


def score_demand(model: PipelineModel, df: DataFrame, features_cat: Sequence[str]) -> DataFrame:
    """Predictions in units (expm1, clipped at 0)."""
    out = model.transform(df.na.fill(P.MISSING_CATEGORY, subset=list(features_cat)))
    return out.withColumn("y_pred", C.invert_log("prediction"))


# M9 -------------------------------------------------------------------------
def train_returns(train_val: DataFrame, num: Sequence[str], cat: Sequence[str], label: str = "returned",
                  depth: int = 5, balance: bool = False, **how) -> PipelineModel:
    """Boosted classifier on observable features only (the label-generating
    columns are never inputs): up to 1,000 rounds, stopped after 50 without a
    higher ROC-AUC on the ``is_val`` rows; optional class weights
    N / (2 N_class). 31 leaves are a depth of 5."""
    data = train_val
    if balance:
        # weights on the class-count table (one row per class), then broadcast
        cnt = data.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
        wts = cnt.select(label, (F.sum("_nc").over(W.partitionBy()) / (F.lit(2.0) * F.col("_nc"))).alias("weight"))
        data = data.join(F.broadcast(wts), label)
    prep = indexed(data.where(~F.col("is_val")), num, cat)
    rows = stored(prep.transform(data).select("features", F.col(label).cast("double").alias("label"), "is_val", *(["weight"] * balance)),
                  "vectors")
    made = boosting.boost(rows.where(~F.col("is_val")).drop("is_val"), rows.where("is_val").drop("is_val"), classifier=True,
                          depth=depth, **how)
    return PipelineModel(stages=[*prep.stages, made.model])


def score_returns(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("return_prob_pred", vector_to_array("probability")[1])


# M12 ------------------------------------------------------------------------
def feature_importance(model: PipelineModel, df: DataFrame, top: int = 15) -> DataFrame:
    """Importances of the final tree stage with the assembled feature names."""
    spark = df.sparkSession
    tree = model.stages[-1]
    sample = model.transform(df.limit(1))
    meta = sample.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {}
    for group in meta.values():
        for a in group:
            names[a["idx"]] = a["name"]
    imp = tree.featureImportances.toArray().tolist()
    rows = [(names.get(i, f"f{i}"), float(v)) for i, v in enumerate(imp)]
    out = spark.createDataFrame(rows, "feature string, importance double")
    return out.orderBy(F.col("importance").desc(), "feature").limit(top)


# M17 ------------------------------------------------------------------------
def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
