"""Feature-store plans: raw sales -> article x week table -> model features.

Physical shape: scan (pruned to 3 columns) -> partial aggregate -> exchange on
(article, week) -> final aggregate -> article attributes (AQE picks broadcast
or sort-merge by size) ; then one exchange on article feeds every window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..operators import aggregates as A
from ..operators import filters as Fi
from ..operators import joins as J
from ..operators import windows as Wn


def weekly_sales_enriched(tx: DataFrame, articles: DataFrame,
                          attrs=tuple(P.ARTICLE_ATTRS)) -> DataFrame:
    """The 13-column weekly table: A1 then J1."""
    return J.enrich_articles(A.weekly_sales(tx), articles, list(attrs))


def lag_features(weekly: DataFrame) -> DataFrame:
    """Lags 1, 2, 4 and rolling means 4, 8 over one article window."""
    return Wn.with_rolling_mean(Wn.with_lags(weekly))


def build_features(weekly: DataFrame, articles: DataFrame, train_end: str,
                   min_train_weeks: int = P.COLD_START_MIN_WEEKS,
                   extended: bool = False) -> DataFrame:
    """Cold start -> lags/rolling -> calendar -> attributes -> logs -> drop
    rows without lag_4 / rolling_mean_8.

    ``extended`` adds quarter, cyclic month and weeks in catalogue (the
    18-feature variant)."""
    w = Fi.cold_start_filter(weekly, train_end, min_train_weeks)
    w = lag_features(w)
    if extended:
        w = Wn.with_weeks_in_catalog(w)
    w = Wn.with_calendar(w, "week", quarter=extended, cyclic=extended)
    w = J.enrich_articles(w, articles, P.CATEGORY_COLS)
    w = w.withColumn("log_units", F.log1p(F.col("units_sold").cast("double")))
    w = Wn.with_log1p(w, ["lag_1", "lag_2", "lag_4", "rolling_mean_4", "rolling_mean_8"])
    return Fi.drop_incomplete(w, ["lag_4", "rolling_mean_8"])
