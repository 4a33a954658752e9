"""MLlib jobs: smoke tests with metric floors."""
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from mercato.ml import clustering as CL
from mercato.ml import models as ML
from mercato.ml.preprocess import group_rare, style_vectors
from mercato.sources.standin import Inputs

from conftest import SF_SMALL


def test_returns_classifier_learns_the_label(spark):
    s = E.queries()["returns_model_metrics"](spark, SF_SMALL).first()
    assert s.roc_auc > 0.55 and 0 < s.brier_score < 0.25


def test_demand_model_predicts_every_test_row(spark):
    q = E.queries()
    pred = q["demand_model_predictions"](spark, SF_SMALL)
    assert pred.where(F.col("y_pred").isNull() | (F.col("y_pred") < 0)).count() == 0
    assert pred.count() > 0


def test_group_rare_buckets(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 2 + [(None,)] * 6, "c string")
    got = {r.c: r.n for r in group_rare(df, df, ["c"], 5).groupBy("c").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 5, "infrequent": 2, "missing": 6}


def test_clusters_and_pca(spark):
    vecs, _ = style_vectors(Inputs(spark, SF_SMALL).articles(),
                            ["product_group_name", "colour_group_name", "garment_group_name"])
    vecs = vecs.cache()
    clusters, model = CL.assign_clusters(vecs, 4, 3)
    assert clusters.select("cluster").distinct().count() == 4
    assert clusters.count() == vecs.count()
    proj, var = CL.pca2(vecs)
    assert proj.count() == vecs.count() and var[0] >= var[1] >= 0
    sweep = CL.k_sweep(vecs, [3, 4]).collect()
    assert [r.k for r in sweep] == [3, 4] and all(-1 <= r.silhouette <= 1 for r in sweep)


def test_week_blocks_are_expanding_and_ordered(spark):
    from mercato.operators import aggregates as A
    w = A.weekly_sales(Inputs(spark, SF_SMALL).transactions())
    b = ML.week_blocks(w, 3).groupBy("block").agg(F.min("week").alias("lo"), F.max("week").alias("hi"),
                                                 F.count("*").alias("n")).orderBy("block").collect()
    assert [r.block for r in b] == [0, 1, 2, 3]
    assert all(b[i].hi < b[i + 1].lo for i in range(3))


def test_ridge_from_sums_equals_mllib(spark):
    """Every penalty of a grid from one pass, against a fit each."""
    import numpy as np
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from mercato.ml import ridge
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 3)) * [1, 20, 0.1] + [0, 5, 3]
    cat = rng.integers(0, 6, 3000)
    y = x @ [1.5, -0.2, 7] + cat * 0.3 + rng.normal(size=3000)
    df = spark.createDataFrame([(*map(float, a), 4.0, float(c), float(t)) for a, c, t in zip(x, cat, y)],
                               "a double, b double, c double, same double, k double, y double").repartition(5)
    df = OneHotEncoder(inputCols=["k"], outputCols=["o"], dropLast=True).fit(df).transform(df)
    df = VectorAssembler(inputCols=["a", "b", "c", "same", "o"], outputCol="features").transform(df)
    penalties = (0.0, 0.1, 1.0, 10.0)
    for penalty, got in zip(penalties, ridge.fit(df, "y", penalties)):
        want = LinearRegression(labelCol="y", regParam=penalty, elasticNetParam=0.0, solver="normal").fit(df)
        assert np.abs(got.coefficients.toArray() - want.coefficients.toArray()).max() < 1e-6
        assert abs(got.intercept - want.intercept) < 1e-6
        both = got.transform(df).select("k", "a", "b", "c", F.col("prediction").alias("p")).join(
            want.transform(df), ["k", "a", "b", "c"])
        gap, size = both.agg(F.max(F.abs(F.col("p") - F.col("prediction"))), F.max(F.abs("prediction"))).first()
        assert gap < 1e-6 * size  # of the predictions; MLlib iterates where the constant column has no penalty


def test_ridge_of_a_constant_label_is_its_mean(spark):
    from pyspark.ml.linalg import Vectors

    from mercato.ml import ridge
    df = spark.createDataFrame([(Vectors.dense([float(i)]), 2.5) for i in range(9)], ["features", "y"])
    model = ridge.fit(df, "y", [0.0])[0]
    assert model.coefficients.toArray().tolist() == [0.0] and model.intercept == pytest.approx(2.5)
    with pytest.raises(ValueError):
        ridge.fit(df.where("y < 0"), "y", [0.0])


def test_rare_categories_are_counted_inside_the_fold(spark, tmp_path):
    """A category rare in the first fold's training rows but frequent later
    is grouped there, and the fitted stage survives saving."""
    from pyspark.ml import Pipeline, PipelineModel

    from mercato.ml.preprocess import INFREQUENT, RareCategories
    rows = [(b, v) for b, v, n in [(0, "old", 80), (0, "late", 3), (1, "old", 60), (1, "late", 90), (1, None, 55)] for _ in range(n)]
    df = spark.createDataFrame(rows, "block int, c string")
    early = RareCategories(["c"], 50).fit(df.where("block <= 0"))
    whole = Pipeline(stages=[RareCategories(["c"], 50)]).fit(df)
    whole.write().overwrite().save(str(tmp_path / "m"))
    counts = lambda m: {r[0]: r["count"] for r in m.transform(df).groupBy("c").count().collect()}
    assert counts(early) == {"old": 140, INFREQUENT: 148}
    assert counts(whole) == counts(PipelineModel.load(str(tmp_path / "m"))) == {"old": 140, "late": 93, "missing": 55}
    assert counts(RareCategories(["c"], 500).fit(df)) == {INFREQUENT: 288}

    cfg = ML.ModelConfig("Ridge", "ridge", [{"regParam": 0.1}], True)
    data = df.withColumn("x", F.rand(3)).withColumn("units_sold", F.lit(2.0) + F.col("x"))
    prep = ML._prep(cfg, data.where("block <= 0"), ["x"], ["c"])
    assert prep.stages[0].getOrDefault("frequent") == {"c": ["old"]}


def test_families_share_folds_and_trees_take_nominal_columns(spark, monkeypatch):
    """Each training set's categories, medians and indexes are read once for
    all families; a tree has one column per attribute, in a piece per core."""
    rows = [(f"c{i % 5}", f"d{i % 3}", float(i % 7), i % 12, float(1 + (i % 5 == 2) * 4 + i % 2)) for i in range(1200)]
    df = spark.createDataFrame(rows, "c string, d string, x double, w int, units_sold double").selectExpr(
        "*", "date_add(date'2020-01-06', w * 7) week").repartition(40).cache()
    plain = ML._prep
    monkeypatch.setattr(ML, "_prep", lambda cfg, train, num=None, cat=None, *a, **how: plain(cfg, train, ["x"], ["c", "d"], *a, **how))
    fitted, fit = [], ML.RareCategories._fit
    monkeypatch.setattr(ML.RareCategories, "_fit", lambda self, data: fitted.append(1) or fit(self, data))
    sizes, make = [], ML._estimator
    monkeypatch.setattr(ML, "_estimator", lambda kind, params, label, categories: sizes.append(categories) or make(kind, params, label, categories))
    configs = [ML.ModelConfig("Dummy", "dummy"), ML.ModelConfig("Ridge", "ridge", [{"regParam": a} for a in (0.1, 1.0)], True),
               ML.ModelConfig("RandomForest", "forest", [{"numTrees": 3, "maxDepth": d} for d in (2, 4)], True),
               ML.ModelConfig("GBT", "gbt", [{"maxIter": 2, "maxDepth": 3, "stepSize": s} for s in (0.3, 1.0)])]
    got = {r.model: r for r in ML.compare_models(configs, df.where("w < 10"), df.where("w >= 10")).collect()}
    assert len(fitted) == 4  # three folds and the whole
    assert set(sizes) == {6} and len(sizes) == 14  # five and the unknown; 2 points x 3 folds and a refit, twice
    assert got["RandomForest"].test_wape < got["Dummy"].test_wape and got["GBT"].test_wape < got["Dummy"].test_wape
    assert got["RandomForest"].best_params == str(configs[2].grid[1])

    tree = plain(configs[3], df, ["x"], ["c", "d"]).transform(df)
    assert len(tree.first().features) == 3
    assert len(plain(configs[1], df, ["x"], ["c", "d"]).transform(df).first().features) == 1 + 6 + 4
    assert ML._pieces(tree, 1200).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_the_registered_comparison_is_the_whole_study(spark, monkeypatch):
    """Five families, 100 trees of depth 10 and 20, two boosters of 200 rounds
    with four points each, fitted on all training rows."""
    seen = []
    monkeypatch.setattr(ML, "compare_models", lambda configs, train, test: seen.append((configs, train.count())) or train)
    E.queries()["model_comparison"](spark, SF_SMALL)
    (configs, rows), = seen
    grids = {c.name: [{**c.fixed, **p} for p in c.grid] for c in configs}
    assert list(grids) == ["Dummy", "Ridge", "RandomForest", "XGBoost", "LightGBM"] and rows > 0
    assert [p["regParam"] for p in grids["Ridge"]] == [0.1, 1.0, 10.0]
    assert [(p["numTrees"], p["maxDepth"]) for p in grids["RandomForest"]] == [(100, 10), (100, 20)]
    assert [(p["rounds"], p["depth"], p["step"]) for p in grids["XGBoost"]] == [(200, d, s) for d in (6, 8) for s in (0.05, 0.1)]
    assert [(p["rounds"], p["leaves"], p["step"]) for p in grids["LightGBM"]] == [(200, n, s) for n in (31, 63) for s in (0.05, 0.1)]


def test_boosters_in_a_comparison(spark, monkeypatch):
    """Chosen by their folds, refitted and scored in units."""
    rows = [(f"c{i % 5}", float(i % 7), i % 12, float(1 + (i % 5 == 2) * 4 + i % 2)) for i in range(1200)]
    df = spark.createDataFrame(rows, "c string, x double, w int, units_sold double").selectExpr("*", "date_add(date'2020-01-06', w * 7) week").cache()
    plain = ML._prep
    monkeypatch.setattr(ML, "_prep", lambda cfg, train, num=None, cat=None, *a, **how: plain(cfg, train, ["x"], ["c"], *a, **how))
    configs = [ML.ModelConfig("Dummy", "dummy"),
               ML.ModelConfig("XGBoost", "boosted", [{"depth": 2, "step": s} for s in (0.01, 0.5)], fixed={"rounds": 8, "leaf_rows": 1, "l2": 1.0}),
               ML.ModelConfig("LightGBM", "boosted", [{"leaves": n, "step": 0.5} for n in (3, 4)], fixed={"rounds": 8, "leaf_rows": 20})]
    got = {r.model: r for r in ML.compare_models(configs, df.where("w < 10"), df.where("w >= 10")).collect()}
    assert got["XGBoost"].best_params == str({"depth": 2, "step": 0.5})
    assert all(got[m].test_wape < 0.5 * got["Dummy"].test_wape for m in ("XGBoost", "LightGBM"))
