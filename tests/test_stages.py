"""Stage store and stage pipeline: publishing, buckets, one scan of the facts."""
import glob
import os
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from mercato.operators import aggregates as A
from mercato.plans import q_planning
from mercato.plans import stage_jobs
from mercato.plans.stage_jobs import Stages
from mercato.sources.stages import StageStore, with_month

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def stages(spark):
    return Stages(spark, SF_SMALL)


def exchanges(df):
    return str(df._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning")


@pytest.fixture()
def no_broadcast(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_demand_and_risk_join_without_an_exchange(spark, stages, no_broadcast):
    base = stages.planning_base()
    assert "SortMergeJoin" in str(base._jdf.queryExecution().executedPlan())
    assert exchanges(base) == 0
    assert exchanges(stages.style_base(clusters=True)) == 0
    # the lags of the weekly table neither
    from mercato.plans import feature_store as FS
    assert exchanges(FS.lag_features(stages.weekly_sales())) == 0


def test_the_fact_table_is_scanned_once(spark, monkeypatch, tmp_path):
    asked = []
    real = stage_jobs.Inputs.transactions
    monkeypatch.setattr(stage_jobs.Inputs, "transactions", lambda self, *a, **k: asked.append(1) or real(self, *a, **k))
    made = Stages(spark, SF_SMALL, root=str(tmp_path / "stages"))
    tables = made.run()
    assert len(tables) == 9 and asked == [1]
    for df in tables.values():
        assert df.count() > 0 and not any("lineitem" in f for f in df.inputFiles())
    # another session object reads what is there
    again = Stages(spark, SF_SMALL, root=str(tmp_path / "stages"))
    assert {n: sorted(map(str, d.collect())) for n, d in again.run().items()} == {n: sorted(map(str, d.collect())) for n, d in tables.items()}
    assert asked == [1]


def test_publishing_is_one_step(spark, tmp_path):
    store = StageStore(spark, str(tmp_path), buckets=4)
    first = store.write("t", spark.range(100).select(F.col("id").alias("k"), F.lit("old").alias("v")), "k")
    old = store.current("t")
    with pytest.raises(Exception):  # a version that fails is never published
        store.write("t", spark.range(9).select(F.col("id").alias("k"), F.raise_error(F.lit("no")).cast("string").alias("v")), "k")
    assert store.current("t") == old and store.read("t").where("v = 'old'").count() == 100
    store.write("t", spark.range(50).select(F.col("id").alias("k"), F.lit("new").alias("v")), "k")
    assert first.where("v = 'old'").count() == 100  # a reader of the old version goes on
    # a session that never saw the table reads its buckets
    spark.sql(f"DROP TABLE {store._table('t', store.current('t')['version'])}")
    fresh = StageStore(spark, str(tmp_path), buckets=4).read("t")
    assert fresh.count() == 50 and exchanges(fresh.groupBy("k").count()) == 0
    assert len(store.versions("t")) >= 2
    store.prune("t")
    assert store.versions("t") == [store.current("t")["version"]] and store.read("t").count() == 50


def test_one_day_rewrites_one_month(spark, stages, tmp_path):
    store = StageStore(spark, str(tmp_path))
    tx = stages.transactions()
    store.write("tx", tx, partition_by="month")
    path = f"{tmp_path}/tx/{store.current('tx')['version']}"
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/month=*/*.parquet")}
    day = tx.orderBy("t_dat", "tx_key").limit(1).withColumn("tx_key", F.lit("new"))
    month = day.first()["month"]
    whole = store.read("tx").where(F.col("month") == F.lit(month)).unionByName(day)
    n = store.read("tx").count()
    store.refresh_months("tx", spark.createDataFrame(whole.collect(), whole.schema))
    after = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/month=*/*.parquet")}
    here = f"month={month}"
    assert {f: t for f, t in before.items() if here not in f} == {f: t for f, t in after.items() if here not in f}
    assert store.read("tx").count() == n + 1


def test_test_period_jobs_read_their_months_only(spark, stages):
    plan = stages.test_transactions()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    want = stages.transactions().where(F.col("t_dat") > F.lit(stages.val_end).cast("date")).count()
    assert stages.test_transactions().count() == want > 0


def test_changed_input_is_read_again(spark, tmp_path):
    copy = tmp_path / "sf"
    copy.mkdir()
    for name in stage_jobs.TABLES:
        shutil.copy(f"{SF_SMALL}/{name}.parquet", copy)
    made = Stages(spark, str(copy), root=str(tmp_path / "stages"))
    n = made.weekly_sales().agg(F.sum("units_sold")).first()[0]
    half = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").limit(1000).toPandas()
    half.to_parquet(copy / "lineitem.parquet", coerce_timestamps="us")
    spark.catalog.refreshByPath(str(copy))
    again = Stages(spark, str(copy), root=str(tmp_path / "stages"))
    assert again.weekly_sales().agg(F.sum("units_sold")).first()[0] == 1000 < n


def test_planning_on_scores_against_sql_over_the_stored_tables(spark, stages, tmp_path):
    """The same planning SQL as the deterministic queries', over the score
    tables that the models wrote."""
    con = duckdb.connect()
    for name, df in (("demand", stages.demand_scores()), ("scored", stages.scored_transactions())):
        df.write.parquet(f"{tmp_path}/{name}")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    want = con.execute("""
        WITH d AS (SELECT article_id, sum(units_sold::DOUBLE) AS actual_demand, sum(y_pred) AS predicted_demand,
                          avg(avg_price) * 800.0 AS price FROM demand GROUP BY 1),
             r AS (SELECT article_id, avg(return_prob_pred) AS p FROM scored GROUP BY 1),
             b AS (SELECT *, greatest(predicted_demand * 1.2, 0) AS q FROM d JOIN r USING (article_id)),
             s AS (SELECT *, least(actual_demand, q) AS sold, greatest(q - actual_demand, 0) AS unsold,
                          greatest(actual_demand - q, 0) AS lost FROM b)
        SELECT sum(q), sum(sold), sum(lost), sum(sold * p * 18.0),
               sum(sold * price + unsold * 0.85 * price * 0.6 - q * price * 0.47 - sold * p * 18.0
                   - unsold * 0.15 * price * 0.47 - lost * price * 0.53) FROM s""").fetchone()
    got = stages.pnl_summary(scores=True).where("scenario like 'Forecast%'").select(
        "total_production", "total_sold_full", "total_lost_demand", "total_return_cost", "total_margin").first()
    assert list(got) == pytest.approx(list(want))
    other = stages.pnl_summary().where("scenario like 'Forecast%'").first()
    assert other["total_margin"] != pytest.approx(got["total_margin"])
    assert q_planning.q_scored_planning_base(spark, SF_SMALL).count() == len(stages.planning_base(scores=True).collect())


def test_cluster_profile_against_pandas(spark, stages):
    base = stages.style_base(clusters=True).toPandas()
    got = {r["cluster"]: r for r in A.cluster_profile(stages.style_base(clusters=True)).collect()}
    assert len(base) == stages.return_predictions().count() and base["cluster"].notna().all()
    for cluster, rows in base.groupby("cluster"):
        assert got[cluster]["n_products"] == len(rows)
        assert got[cluster]["return_rate"] == pytest.approx(rows["avg_return_prob"].mean())
        assert got[cluster]["top_garment"] == rows["garment_group_name"].mode().min()
    assert A.style_kpis(stages.style_base(clusters=True)).first()["n_clusters"] == len(got) == 4


def test_what_if_takes_a_large_grid_in_one_aggregate(spark, stages):
    """10,000 parameter rows: the articles are not multiplied by them, and
    each row equals the P&L recomputed for it."""
    from mercato.operators import planning as PL
    from mercato.params import EconParams
    grid = spark.range(10_000).select((F.col("id") % 100 / 100 + 0.001).alias("g"), (F.col("id") % 37 + 1.0).alias("c"),
                                      (F.col("id") % 11 / 11).alias("m"), (F.col("id") % 7 / 7).alias("d"))
    base = stages.policies()
    out = PL.what_if(base, grid, "prod_naive")
    assert out.count() == 10_000
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    for row in out.orderBy(F.xxhash64("g", "c", "m", "d")).limit(5).collect():
        pnl = PL.with_pnl(base, "actual_demand", "prod_naive", "return_prob", "avg_price_eur",
                          EconParams(gross_margin=row["g"], return_cost=row["c"], markdown=row["m"], destruction=row["d"]))
        want = PL.portfolio_pnl(pnl, return_cost_eur=row["c"]).first()
        for k in want.asDict():
            assert row[k] == pytest.approx(want[k], rel=1e-9, abs=1e-6), k
