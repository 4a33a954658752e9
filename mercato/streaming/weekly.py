"""Incremental weekly sales (A1) with Structured Streaming.

The reference only reads complete files; this is the same article x week
aggregate kept up to date as new transaction files land. Each micro-batch's
updated (article, week) groups are appended to an output folder tagged with
the batch id (update mode + foreachBatch: exactly-once per batch because the
batch id is part of the written path and a replayed batch overwrites its own
folder); readers keep the latest version of every group. Weeks are event-time
windows, so the watermark reaches the state: a week that ended longer ago
than ``lateness`` is final and leaves the state, and rows for it that come
later still are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import params as P
from ..functions.columns import normalize_key

LATENESS = "56 days"  # how long after its week a row may come


def weekly_sales_stream(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Streaming A1 over a stream of lineitem-shaped rows. Windows of seven
    days start on Mondays (1970-01-05 was one)."""
    tx = events.select(
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        normalize_key("l_partkey").alias("article_id"),
        (F.col("l_extendedprice") / F.lit(P.STANDIN_PRICE_DIVISOR)).alias("price"))
    return (tx.withWatermark("ts", lateness)
              .where(F.col("article_id").isNotNull() & F.col("ts").isNotNull())
              .groupBy("article_id", F.window("ts", "7 days", "7 days", "4 days").alias("_window"))
              .agg(F.count(F.lit(1)).alias("units_sold"), F.avg("price").alias("avg_price"))
              .select("article_id", F.to_date("_window.start").alias("week"), "units_sold", "avg_price"))


def run_weekly_sales(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str,
                     pattern: str = "lineitem*.parquet", lateness: str = LATENESS) -> None:
    """Process everything available in ``source_dir`` (availableNow) into
    ``out_dir``; safe to re-run — the checkpoint records progress."""
    schema = spark.read.parquet(f"{source_dir.rstrip('/')}/{pattern}").schema
    events = (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
                   .option("maxFilesPerTrigger", 16).parquet(source_dir))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
              .write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch_id={batch_id}"))

    q = (weekly_sales_stream(events, lateness).writeStream.outputMode("update")
         .option("checkpointLocation", checkpoint).foreachBatch(write_batch)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def latest_weekly_sales(spark: SparkSession, out_dir: str) -> DataFrame:
    """Current table: the latest batch's version of every (article, week)."""
    raw = spark.read.parquet(out_dir)
    w = W.partitionBy("article_id", "week")
    return (raw.withColumn("_last", F.max("batch_id").over(w)).where(F.col("batch_id") == F.col("_last"))
               .select("article_id", "week", "units_sold", "avg_price"))
