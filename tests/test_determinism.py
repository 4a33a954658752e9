"""Seeded draws do not depend on partitioning."""
from pyspark.sql import functions as F

from mercato.functions.random import normal, uniform
from mercato.operators import topk as K
from mercato.sources.standin import Inputs

from conftest import SF_SMALL


def test_draws_same_under_repartition(spark):
    tx = Inputs(spark, SF_SMALL).transactions().select("tx_key")
    a = tx.repartition(1).select("tx_key", uniform(["tx_key"], "s").alias("u"),
                                 normal(["tx_key"], "n").alias("z"))
    b = tx.repartition(13).select("tx_key", uniform(["tx_key"], "s").alias("u"),
                                  normal(["tx_key"], "n").alias("z"))
    assert sorted(a.collect()) == sorted(b.collect())
    stats = a.agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert 0.45 < stats[0] < 0.55 and stats[1] > 0 and stats[2] < 1


def test_sample_n_independent_of_partitions(spark):
    tx = Inputs(spark, SF_SMALL).transactions().select("tx_key")
    s1 = {r.tx_key for r in K.sample_n(tx.repartition(2), 500, ["tx_key"]).collect()}
    s2 = {r.tx_key for r in K.sample_n(tx.repartition(9), 500, ["tx_key"]).collect()}
    s3 = {r.tx_key for r in K.sample_n(tx.repartition(5), 500, ["tx_key"]).collect()}
    assert s1 == s2 == s3 and len(s1) == 500
