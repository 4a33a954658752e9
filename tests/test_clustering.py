"""Style vectors come from one small file; the fits use all cores."""
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from mercato.ml import clustering as CL


def test_vectors_of_one_part_are_spread_in_a_fixed_order(spark):
    rows = spark.range(0, 25_000, 1, 1).select(F.col("id").alias("article_id"), (F.col("id") % 4 * 10.0).alias("x"), (F.col("id") % 3 / 10.0).alias("y"))
    vecs = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(rows)
    a, b = CL.spread(vecs), CL.spread(vecs)
    assert vecs.rdd.getNumPartitions() == 1 and a.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, a.rdd.glom().map(lambda p: [r.article_id for r in p]).collect())) == sorted(
        map(tuple, b.rdd.glom().map(lambda p: [r.article_id for r in p]).collect()))
    assert a.exceptAll(vecs.select("article_id", "features")).isEmpty() and a.count() == 25_000
    got, model = CL.assign_clusters(vecs, 4, 3)
    # the four groups lie ten apart, their members 0.2 at most
    assert got.join(rows, "article_id").groupBy("cluster").agg(F.count_distinct("x").alias("n")).where("n > 1").isEmpty()
    assert got.select("cluster").distinct().count() == 4 and model.summary.trainingCost < 25_000
