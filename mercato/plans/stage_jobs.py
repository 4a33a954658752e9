"""The stage pipeline: one graph of jobs from the raw tables to the planning
tables, each written once and read by the next (S4, S6).

    transactions (by month) -> weekly_sales -> demand_predictions  --+
         |                                                           +-> simulator_per_article -> summary,
         +-> return_predictions -----------------------------------  +      sensitivity, top 20
    article_features, article_clusters

Only ``transactions`` reads the fact table. Stages keyed by article are
bucketed by it, so the lag windows and the demand x risk join read their
buckets and shuffle nothing. ``demand_scores`` and ``return_scores`` are the
same tables from the fitted models, which are stored and versioned too.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..ml import clustering as CL
from ..ml import models as ML
from ..ml.preprocess import style_vectors
from ..operators import aggregates as A
from ..operators import evaluation as E
from ..operators import filters as Fi
from ..operators import joins as J
from ..operators import planning as PL
from ..operators import topk as K
from ..sources.stages import StageStore, store_for, with_month
from ..sources.standin import Inputs
from . import feature_store as FS
from . import returns as RT

KEY = "article_id"
TABLES = ["lineitem", "orders", "part", "customer"]
STYLE_COLS = ["product_group_name", "colour_group_name", "department_name", "index_group_name", "garment_group_name"]
FEATS_18_NUM = ["log_lag_1", "log_lag_2", "log_lag_4", "log_rolling_mean_4", "log_rolling_mean_8", "month",
                "week_of_year", "quarter", "month_sin", "month_cos", "weeks_in_catalog", "avg_price"]
FEATS_14_NUM = ["log_lag_1", "log_lag_2", "log_lag_4", "log_rolling_mean_4", "log_rolling_mean_8", "month", "week_of_year", "avg_price"]
RETURN_NUM = ["price", "age", "day_of_week", "month"]


class Stages:
    """The stages of one input folder; each is built when first asked for and
    rebuilt when the input's files changed."""

    def __init__(self, spark: SparkSession, sf_dir: str, root: str | None = None, train_end: str = P.STANDIN_TRAIN_END,
                 val_end: str = P.STANDIN_VAL_END):
        self.spark, self.inputs = spark, Inputs(spark, sf_dir)
        self.train_end, self.val_end = train_end, val_end
        self.store: StageStore
        self.store, state = store_for(spark, sf_dir, TABLES, root)
        self.source = f"{state}:{train_end}:{val_end}"

    def _stage(self, name: str, build, key: str | None = None, partition_by: str | None = None) -> DataFrame:
        return self.store.ensure(name, self.source, build, key, partition_by)

    # facts -----------------------------------------------------------------------
    def transactions(self) -> DataFrame:
        """The only scan of the fact table (S1 by month)."""
        return self._stage("transactions", lambda: with_month(self.inputs.transactions(with_customer=True), "t_dat"), partition_by="month")

    def test_transactions(self) -> DataFrame:
        """The transactions after the validation end: the months before it
        are pruned."""
        end = F.lit(self.val_end).cast("date")
        return self.transactions().where((F.col("month") >= F.trunc(end, "MM")) & (F.col("t_dat") > end))

    def weekly_sales(self) -> DataFrame:
        return self._stage("weekly_sales", lambda: A.weekly_sales(self.transactions()), KEY)

    def article_features(self) -> DataFrame:
        def build():
            return J.semi_by_keys(self.inputs.articles(), self.weekly_sales().select(KEY).distinct())
        return self._stage("article_features", build, KEY)

    # demand and risk --------------------------------------------------------------
    def demand_predictions(self) -> DataFrame:
        """The deterministic prediction of the test weeks."""
        def build():
            f = FS.lag_features(self.weekly_sales())
            f = f.where((F.col("week") > F.lit(self.val_end).cast("date")) & F.col("lag_4").isNotNull())
            return f.select(KEY, "week", "units_sold", "avg_price", F.col("rolling_mean_4").alias("y_pred"))
        return self._stage("demand_predictions", build, KEY)

    def labelled(self) -> DataFrame:
        return RT.labelled_transactions(self.transactions(), self.inputs.articles(), self.inputs.customers(),
                                        cols=[KEY, "t_dat", "age", *P.RETURN_CAT_FEATURES])

    def return_predictions(self) -> DataFrame:
        """Medians of all transactions; labels and risk of the test period."""
        def build():
            articles, customers = self.inputs.articles(), self.inputs.customers()
            medians = RT.price_medians(self.transactions(), articles, customers)
            test = RT.joined_transactions(self.transactions().where(F.col("t_dat") > F.lit(self.val_end).cast("date")), articles, customers)
            return RT.article_risk(RT.labels(test.join(medians, "product_group_name", "left")), self.val_end)
        return self._stage("return_predictions", build, KEY)

    # models ------------------------------------------------------------------------
    def demand_features(self) -> DataFrame:
        """The 18-feature set with its split."""
        def build():
            f = FS.build_features(self.weekly_sales(), self.inputs.articles(), self.train_end, P.STANDIN_COLD_START_WEEKS, extended=True)
            return Fi.with_split(f, "week", self.train_end, self.val_end).withColumn("is_val", F.col("split") == "val")
        return self._stage("demand_features", build, KEY)

    def demand_model(self) -> PipelineModel:
        def fit():
            known = self.demand_features().where(F.col("split") != "test")
            return ML.train_demand(known, FEATS_18_NUM, P.CATEGORY_COLS)
        return self.store.ensure_model("demand_model", self.source, fit)

    def small_demand_model(self) -> PipelineModel:
        """The 14-feature variant."""
        def fit():
            return ML.train_demand(self.demand_features().where(F.col("split") != "test"), FEATS_14_NUM, P.CATEGORY_COLS)
        return self.store.ensure_model("small_demand_model", self.source, fit)

    def demand_scores(self) -> DataFrame:
        """The model's ``demand_predictions``, with the lags the baselines use."""
        def build():
            f = self.demand_features()
            scored = ML.score_demand(self.demand_model(), f.where(F.col("split") == "test"), P.CATEGORY_COLS)
            scored = E.clip_to_train_range(scored, f.where(F.col("split") == "train"), "y_pred")
            return scored.select(KEY, "week", "units_sold", "avg_price", "y_pred", "lag_1", "rolling_mean_4")
        return self._stage("demand_scores", build, KEY)

    def return_features(self) -> DataFrame:
        def build():
            f = Fi.with_split(RT.return_features(self.labelled()), "t_dat", self.train_end, self.val_end)
            return f.withColumn("is_val", F.col("split") == "val").select(
                "tx_key", KEY, "t_dat", "split", "is_val", "returned", "returned_flag", *RETURN_NUM, *P.RETURN_CAT_FEATURES)
        return self._stage("return_features", build)

    def return_model(self) -> PipelineModel:
        def fit():
            return ML.train_returns(self.return_features().where(F.col("split") != "test"), RETURN_NUM, P.RETURN_CAT_FEATURES)
        return self.store.ensure_model("return_model", self.source, fit)

    def scored_transactions(self) -> DataFrame:
        """The test transactions with the classifier's probability."""
        def build():
            test = self.return_features().where(F.col("split") == "test")
            return ML.score_returns(self.return_model(), test).select("tx_key", KEY, "returned", "returned_flag", "return_prob_pred")
        return self._stage("scored_transactions", build)

    def return_scores(self) -> DataFrame:
        """The model's ``return_predictions``."""
        return self._stage("return_scores", lambda: A.article_return_risk(self.scored_transactions(), "return_prob_pred", "returned_flag"), KEY)

    # styles ------------------------------------------------------------------------
    def article_clusters(self) -> DataFrame:
        def build():
            vecs, _ = style_vectors(self.inputs.articles(), STYLE_COLS)
            return CL.assign_clusters(vecs.select(KEY, "features"), 4, 10)[0]
        return self._stage("article_clusters", build, KEY)

    def style_base(self, clusters: bool = False) -> DataFrame:
        """Risk, attributes and, if wanted, clusters."""
        out = J.style_base(self.return_predictions(), self.article_features(), self.article_clusters() if clusters else None)
        return out

    # planning ------------------------------------------------------------------------
    def planning_base(self, scores: bool = False) -> DataFrame:
        """A9 + J4 over the stage tables: both sides are bucketed by article,
        so neither the totals nor the join move a row. ``scores`` takes the
        models' tables."""
        demand, risk = ((self.demand_scores(), self.return_scores()) if scores
                        else (self.demand_predictions(), self.return_predictions()))
        return J.planning_base(A.article_demand(demand), risk)

    def policies(self, scores: bool = False) -> DataFrame:
        return self._stage("simulator_policies" + "_scored" * scores, lambda: PL.with_policies(self.planning_base(scores)), KEY)

    def per_article(self, scores: bool = False) -> DataFrame:
        """``simulator_per_article``: the four policies and the reallocation."""
        def build():
            base = self.policies(scores)
            made = PL.reallocate(base, PL.total(base, "prod_oracle"), [P.ALPHA_OPTIMAL])
            return PL.with_reallocation_delta(made.withColumnRenamed("production", "prod_optimized").drop("alpha"))
        return self._stage("simulator_per_article" + "_scored" * scores, build, KEY)

    def pnl_summary(self, scores: bool = False) -> DataFrame:
        def build():
            return PL.evaluate_scenarios(self.per_article(scores), {v: k for k, v in PL.SCENARIO_NAMES.items()})
        return self._stage("simulator_pnl_summary" + "_scored" * scores, build)

    def sensitivity(self) -> DataFrame:
        return self._stage("simulator_sensitivity", lambda: PL.alpha_sweep(self.policies(), PL.total(self.policies(), "prod_oracle")))

    def top20(self) -> DataFrame:
        """``simulator_top20_reassign`` (T-c)."""
        return self._stage("simulator_top20_reassign", lambda: K.top_k(self.per_article(), 20, "margin_saved_eur"))

    def run(self) -> dict[str, DataFrame]:
        """All stage tables of the reference's pipeline."""
        return {"weekly_sales": self.weekly_sales(), "article_features": self.article_features(),
                "demand_predictions": self.demand_predictions(), "return_predictions": self.return_predictions(),
                "article_clusters": self.article_clusters(), "simulator_per_article": self.per_article(),
                "simulator_pnl_summary": self.pnl_summary(), "simulator_sensitivity": self.sensitivity(),
                "simulator_top20_reassign": self.top20()}
