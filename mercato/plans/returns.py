"""Return-risk plans: semi-synthetic return labels and per-article risk.

Labelled transactions = transactions ⟕ article attributes ⟕ customer
attributes, rows without product metadata dropped, then
return probability = clip(base rate x price factor x engagement factor) plus
seeded noise, and a Bernoulli label drawn from a seeded uniform. Both draws
are md5 functions of the transaction key, so a re-run (after an executor
loss, or on another partitioning) labels every row identically.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import columns as C
from ..functions import random as Rn
from ..operators import aggregates as A
from ..operators import filters as Fi
from ..operators import joins as J
from ..operators import windows as Wn
from ..session import stored

ATTRS = ["product_group_name", "product_type_name", "colour_group_name", "department_name",
         "index_group_name", "garment_group_name"]


# What the labels are made from.
LABEL_COLS = ["product_group_name", "price", "fashion_news_frequency", "returned"]


def joined_transactions(tx: DataFrame, articles: DataFrame, customers: DataFrame) -> DataFrame:
    """J1 + J3 + F1: the transactions with their attributes. The customer's
    few columns come first: the article's wide ones are not moved again."""
    t = J.enrich_customers(tx, customers)
    return Fi.drop_incomplete(J.enrich_articles(t, articles, ATTRS), ["product_group_name"])


def price_medians(tx: DataFrame, articles: DataFrame, customers: DataFrame) -> DataFrame:
    """W4 for readers of few of the transactions: the medians of all of them
    from a stored table of groups and prices. The customers are left out of
    the join where no id repeats, as they add no row then."""
    dealt = customers.agg(F.count("customer_id") == F.countDistinct("customer_id")).first()[0]
    t = J.enrich_articles(tx if dealt else J.enrich_customers(tx, customers, ()), articles, ["product_group_name"])
    pairs = stored(Fi.drop_incomplete(t, ["product_group_name"]).select("product_group_name", "price"), "prices")
    return Wn.group_medians(pairs, "product_group_name", "price", "price_median_group")


def labelled_transactions(tx: DataFrame, articles: DataFrame, customers: DataFrame,
                          lp: P.ReturnLabelParams = P.ReturnLabelParams(),
                          key: str = "tx_key", cols: Sequence[str] | None = None) -> DataFrame:
    """The joined rows are stored, so the medians and the labels read them
    without joining again; ``cols`` are the columns the caller reads besides
    the labels (default: all)."""
    t = joined_transactions(tx, articles, customers)
    if cols is not None:
        t = t.select(*dict.fromkeys([key, *LABEL_COLS, *cols]))
    t = stored(t, "joined")
    return labels(Wn.with_group_median(t, "product_group_name", "price", "price_median_group"), lp, key)


def labels(t: DataFrame, lp: P.ReturnLabelParams = P.ReturnLabelParams(), key: str = "tx_key") -> DataFrame:
    """C9-C13 for joined transactions with the median of their group."""
    t = t.withColumn("base_rate", C.lookup_rate("product_group_name", lp.rates, lp.default_rate))
    t = (t.withColumn("price_factor", C.price_factor("price", "price_median_group"))
          .withColumn("customer_factor", C.engagement_factor("fashion_news_frequency")))
    p0 = C.clip(F.col("base_rate") * F.col("price_factor") * F.col("customer_factor"),
                P.RETURN_PROB_MIN, P.RETURN_PROB_MAX)
    noise = Rn.normal([key], f"noise:{lp.seed}", 0.0, lp.noise_std)
    t = t.withColumn("return_prob_clean", p0)
    t = t.withColumn("return_prob", C.clip(F.col("return_prob_clean") + noise,
                                           P.RETURN_PROB_MIN, P.RETURN_PROB_MAX))
    u = Rn.uniform([key], f"label:{lp.seed}")
    return t.withColumn("returned_flag", F.col("returned")).withColumn(
        "returned", (u < F.col("return_prob")).cast("int"))


def return_features(labelled: DataFrame) -> DataFrame:
    """Model features: categories filled with 'Unknown' (C14), age filled with
    its median (C15), day of week (Monday = 0) and month (C4)."""
    from ..operators.evaluation import fill_median
    t = labelled.na.fill(P.UNKNOWN_CATEGORY, subset=P.RETURN_CAT_FEATURES)
    t = fill_median(t, "age")
    return t.withColumn("day_of_week", C.day_of_week_monday0("t_dat")).withColumn("month", F.month("t_dat"))


def article_risk(labelled: DataFrame, val_end: str, prob: str = "return_prob_clean",
                 observed: str = "returned_flag") -> DataFrame:
    """A8 over the test period: mean predicted probability, observed return
    rate and transaction count per article."""
    test = labelled.where(F.col("t_dat") > F.lit(val_end).cast("date"))
    return A.article_return_risk(test, prob, observed)
