"""Forecast-evaluation plans.

``baseline_predictions`` is the deterministic stand-in for the demand model's
output table (article, week, units_sold, y_pred, avg_price): test weeks with
four previous observed rows, predicted by the mean of the previous four rows.
Model predictions from :mod:`mercato.ml` have the same shape and go through
the same evaluation jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A
from . import feature_store as FS


def baseline_predictions(tx: DataFrame, val_end: str) -> DataFrame:
    f = FS.lag_features(A.weekly_sales(tx))
    return (f.where((F.col("week") > F.lit(val_end).cast("date")) & F.col("lag_4").isNotNull())
             .select("article_id", "week", "units_sold", "avg_price", "lag_1", "rolling_mean_4",
                     F.col("rolling_mean_4").alias("y_pred")))
