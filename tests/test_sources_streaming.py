"""Sources, sinks and the streaming aggregate."""
import tempfile

import pytest
from pyspark.sql import functions as F

from mercato.operators import aggregates as A
from mercato.sources import io
from mercato.sources.standin import Inputs
from mercato.streaming.weekly import latest_weekly_sales, run_weekly_sales

from conftest import SF_SMALL


def test_read_transactions_csv_with_fixed_schema_and_nrows(spark):
    d = tempfile.mkdtemp(prefix="mercato-csv-")
    tx = Inputs(spark, SF_SMALL).transactions(True)
    raw = tx.select(F.col("t_dat").cast("string").alias("t_dat"), "customer_id",
                    F.regexp_replace("article_id", "^0+", "").alias("article_id"), "price",
                    F.lit(1).cast("byte").alias("sales_channel_id"))
    io.write_csv(raw.coalesce(1), d + "/tx")
    back = io.read_transactions(spark, d + "/tx", fmt="csv")
    assert dict(back.dtypes)["t_dat"] == "date" and dict(back.dtypes)["price"] == "float"
    assert back.count() == tx.count()
    assert back.where(F.length("article_id") != 10).count() == 0  # zero-padded again
    assert io.read_transactions(spark, d + "/tx", nrows=7, fmt="csv").count() == 7


def test_stage_write_read_partitioned(spark):
    d = tempfile.mkdtemp(prefix="mercato-stage-")
    w = A.weekly_sales(Inputs(spark, SF_SMALL).transactions()).withColumn("year", F.year("week"))
    io.write_stage(w, d, "weekly_sales", partition_by="year")
    back = io.read_stage(spark, d, "weekly_sales")
    assert back.count() == w.count()
    # partition pruning: a filter on the partition column reads only matching folders
    plan = back.where(F.col("year") == 1999)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "1999" in plan


def test_streaming_weekly_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="mercato-stream-")
    run_weekly_sales(spark, SF_SMALL, base + "/out", base + "/ckpt")
    # a second run over the same files is a no-op thanks to the checkpoint
    run_weekly_sales(spark, SF_SMALL, base + "/out", base + "/ckpt")
    got = latest_weekly_sales(spark, base + "/out")
    want = A.weekly_sales(Inputs(spark, SF_SMALL).transactions())
    g = {(r.article_id, r.week): (r.units_sold, round(r.avg_price, 9)) for r in got.collect()}
    w = {(r.article_id, r.week): (r.units_sold, round(r.avg_price, 9)) for r in want.collect()}
    assert g == w


def test_table_profile(spark):
    inp = Inputs(spark, SF_SMALL)
    rows = {r.table_name: r for r in io.table_profile({"a": inp.articles(), "c": inp.customers()}).collect()}
    assert rows["a"].n_rows == inp.articles().count() and rows["a"].n_cols == len(inp.articles().columns)
