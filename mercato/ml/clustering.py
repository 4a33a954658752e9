"""K sweep, final clustering (best of several starts), PCA."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

ROWS_PER_PART = 10_000
FITS_AT_ONCE = 4


def spread(vecs: DataFrame, key: str = "article_id") -> DataFrame:
    """The vectors, stored once in parts for all cores and in a fixed order:
    a dimension table is one small file, which a scan leaves to one task. A
    fit holds the rows it reads in its own form, so they are not cached here."""
    cores = vecs.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(2 * cores, -(-vecs.count() // ROWS_PER_PART)))
    return stored(vecs.select(key, "features").repartition(parts, key).sortWithinPartitions(key), "vectors")


def best_of(vecs: DataFrame, k: int, starts: int):
    """The seeded fit of lowest cost (the first of equal ones). Fits run side
    by side: the jobs of one are short."""
    with ThreadPoolExecutor(FITS_AT_ONCE) as ex:
        fits = list(ex.map(lambda s: KMeans(k=k, seed=s, featuresCol="features").fit(vecs), range(starts)))
    return min(fits, key=lambda m: m.summary.trainingCost)


def k_sweep(vecs: DataFrame, ks: Sequence[int] = (3, 4, 5, 6, 7, 8), starts: int = 10) -> DataFrame:
    """Inertia (training cost) and silhouette (all rows, squared Euclidean)
    per k, each the best of ``starts`` fits."""
    spark, vecs = vecs.sparkSession, spread(vecs)
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="prediction")
    rows = []
    for k in ks:
        m = best_of(vecs, k, starts)
        rows.append((int(k), float(m.summary.trainingCost), float(ev.evaluate(m.transform(vecs)))))
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double")


def assign_clusters(vecs: DataFrame, k: int = 4, starts: int = 10, key: str = "article_id"):
    """Best of ``starts`` seeded fits (lowest cost); returns (key, cluster)
    and the model."""
    vecs = spread(vecs, key)
    best = best_of(vecs, k, starts)
    out = best.transform(vecs).select(key, F.col("prediction").cast("int").alias("cluster"))
    return out, best


def pca2(vecs: DataFrame, key: str = "article_id"):
    """2-D projection of the centred vectors and the explained variance."""
    centred = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="_c").fit(vecs).transform(vecs)
    model = PCA(k=2, inputCol="_c", outputCol="_pc").fit(centred)
    proj = model.transform(centred).select(key, vector_to_array("_pc").alias("_a")).select(
        key, F.col("_a")[0].alias("pc1"), F.col("_a")[1].alias("pc2"))
    return proj, [float(v) for v in model.explainedVariance.toArray()]
