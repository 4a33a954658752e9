"""Production-planning plans: predictions + return risk -> article plan ->
policies -> scenario P&L, comparison, α sweep and reallocation report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import columns as C
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import planning as PL
from .forecast import baseline_predictions
from .returns import article_risk, labelled_transactions


def planning_base(tx: DataFrame, tx_with_customer: DataFrame, articles: DataFrame,
                  customers: DataFrame, val_end: str) -> DataFrame:
    """A9 + J4: per-article actual / predicted demand, price (EUR) and
    return probability, inner-joined."""
    demand = A.article_demand(baseline_predictions(tx, val_end))
    risk = article_risk(labelled_transactions(tx_with_customer, articles, customers), val_end)
    return J.planning_base(demand, risk)


def policy_table(base: DataFrame) -> DataFrame:
    """Policies per article, stored once: the budget total, the
    reallocation rounds and every scenario read this table instead
    of recomputing the demand and return-risk jobs behind it."""
    from ..session import stored
    return stored(PL.with_policies(base), "policies")


def production_plan(base: DataFrame, alpha: float = P.ALPHA_OPTIMAL, stored: bool = False) -> DataFrame:
    """The four policies per article plus the naive -> optimized delta (P10).
    ``stored``: ``base`` already is a :func:`policy_table`."""
    b = base if stored else policy_table(base)
    budget = PL.total(b, "prod_oracle")
    opt = PL.reallocate(b, budget, [alpha]).withColumnRenamed("production", "prod_optimized").drop("alpha")
    return PL.with_reallocation_delta(opt)


def scenario_summary(plan: DataFrame) -> DataFrame:
    return PL.evaluate_scenarios(plan, {v: k for k, v in PL.SCENARIO_NAMES.items()})


def executive_summary(plan: DataFrame, sweep: DataFrame) -> DataFrame:
    """One nested row — scenarios array, impact struct, best α, gap to
    oracle, sensitivity array and the assumptions."""
    from ..operators.prefix import join_one_row
    scen = scenario_summary(plan)
    scen_arr = scen.agg(F.sort_array(F.collect_list(F.struct(*scen.columns))).alias("scenarios"))
    impact = PL.compare_scenarios(scen)
    imp = impact.select(F.struct(*[c for c in impact.columns if c != "gap_to_oracle_eur"]).alias("impact_vs_naive"),
                        "gap_to_oracle_eur")
    sens = sweep.agg(F.sort_array(F.collect_list(F.struct("alpha", "margin_M", "production_M", "unsold_M",
                                                          "return_cost_M"))).alias("sensitivity"),
                     F.max("best_alpha").alias("best_alpha"))
    assumptions = F.struct(F.lit(P.GROSS_MARGIN_PCT).alias("gross_margin_pct"),
                           F.lit(P.RETURN_HANDLING_COST_EUR).alias("return_handling_cost_eur"),
                           F.lit(P.MARKDOWN_DISCOUNT_PCT).alias("markdown_pct"),
                           F.lit(P.UNSOLD_DESTRUCTION_RATE).alias("destruction_rate"),
                           F.lit(P.PRICE_TO_EUR).alias("price_to_eur_factor"))
    budget = plan.agg(F.sum("prod_oracle").alias("budget_units"))
    out = join_one_row(join_one_row(join_one_row(scen_arr, imp), sens), budget)
    return out.select("scenarios", "impact_vs_naive", F.lit(P.ALPHA_OPTIMAL).alias("alpha_optimal"),
                      "gap_to_oracle_eur", "sensitivity", "best_alpha", "budget_units",
                      assumptions.alias("assumptions"))


def summary_rows(summary: DataFrame) -> DataFrame:
    """The nested summary as rows: section, item, metric, value."""
    def rows(df: DataFrame, section: str, item, struct: str, fields) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(f).alias("metric"), F.col(f"{struct}.{f}").cast("double").alias("value"))
                          for f in fields])
        return df.select(F.lit(section).alias("section"), item.alias("item"), F.explode(pairs).alias("_p")).select(
            "section", "item", "_p.*")

    def fields(column: str) -> list[str]:
        kind = summary.schema[column].dataType
        return (kind.elementType if hasattr(kind, "elementType") else kind).names

    scen = summary.select(F.explode("scenarios").alias("s"))
    sens = summary.select(F.explode("sensitivity").alias("s"))
    none = F.lit("")
    top = summary.select(F.struct("alpha_optimal", "gap_to_oracle_eur", "best_alpha", "budget_units").alias("s"))
    parts = [
        rows(scen, "scenario", F.col("s.scenario"), "s", [f for f in fields("scenarios") if f != "scenario"]),
        rows(summary, "impact", none, "impact_vs_naive", fields("impact_vs_naive")),
        rows(sens, "sensitivity", C.stable_round(F.col("s.alpha")).cast("string"), "s",
             [f for f in fields("sensitivity") if f != "alpha"]),
        rows(top, "summary", none, "s", ["alpha_optimal", "gap_to_oracle_eur", "best_alpha", "budget_units"]),
        rows(summary, "assumptions", none, "assumptions", fields("assumptions")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
