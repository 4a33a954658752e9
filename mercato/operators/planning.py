"""Production planning and P&L.

P1 is pure column arithmetic (one codegen'd projection). Policies are
columns. The budget-constrained reallocation (P6) is iterative: each round
needs two totals per α, so each round is one aggregate over a stored
(article x α) table whose <= len(alphas) x 3 result values come back to the
driver and are applied as literals — the plan stays a narrow projection over
one stored input, the shuffle per round is a partial aggregate of a handful
of rows per task, and no article is ever grouped into a single task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.random import normal
from ..session import stored

PNL_COLS = ["production_qty", "sold_full_price", "sold_at_markdown", "destroyed", "lost_demand",
            "revenue_full", "revenue_markdown", "cost_of_goods", "return_cost", "destruction_cost",
            "lost_margin_cost", "expected_margin"]


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(float(x))


# P1 -------------------------------------------------------------------------
def pnl_columns(demand, qty, p, price, g=P.GROSS_MARGIN_PCT, c=P.RETURN_HANDLING_COST_EUR,
                m=P.MARKDOWN_DISCOUNT_PCT, d=P.UNSOLD_DESTRUCTION_RATE) -> dict[str, Column]:
    """The twelve P&L columns of one article for a production decision.
    Parameters may be numbers (literals) or columns (what-if grids)."""
    dem, q, pr, price = _c(demand), _c(qty), _c(p), _c(price)
    g_, c_, m_, d_ = _c(g), _c(c), _c(m), _c(d)
    one_minus = (lambda x: F.lit(1.0 - float(x))) if all(
        isinstance(v, (int, float)) for v in (g, m, d)) else (lambda x: F.lit(1.0) - _c(x))
    sold = F.least(dem, q)
    unsold = F.greatest(q - dem, F.lit(0.0))
    markdown_units = unsold * one_minus(d)
    destroyed = unsold * d_
    lost = F.greatest(dem - q, F.lit(0.0))
    lost_margin = lost * price * g_
    rev_full = sold * price
    rev_markdown = markdown_units * price * one_minus(m)
    cogs = q * price * one_minus(g)
    ret_cost = sold * pr * c_
    destr_cost = destroyed * price * one_minus(g)
    margin = rev_full + rev_markdown - cogs - ret_cost - destr_cost - lost_margin
    vals = [q, sold, markdown_units, destroyed, lost, rev_full, rev_markdown, cogs, ret_cost,
            destr_cost, lost_margin, margin]
    return dict(zip(PNL_COLS, vals))


def with_pnl(df: DataFrame, demand: str, qty: str, p: str, price: str,
             params: P.EconParams = P.EconParams()) -> DataFrame:
    cols = pnl_columns(demand, qty, p, price, params.gross_margin, params.return_cost,
                       params.markdown, params.destruction)
    return df.select("*", *[v.cast("double").alias(k) for k, v in cols.items()])


# P2 -------------------------------------------------------------------------
def portfolio_pnl(pnl: DataFrame, by: Sequence[str] = (),
                  return_cost_eur: float = P.RETURN_HANDLING_COST_EUR) -> DataFrame:
    """Portfolio totals (plus returned units = return cost / unit cost)."""
    g = pnl.groupBy(*by) if by else pnl
    out = g.agg(F.sum("production_qty").alias("total_production"),
                F.sum("sold_full_price").alias("total_sold_full"),
                (F.sum("sold_at_markdown") + F.sum("destroyed")).alias("total_unsold"),
                F.sum("lost_demand").alias("total_lost_demand"),
                (F.sum("revenue_full") + F.sum("revenue_markdown")).alias("total_revenue"),
                F.sum("return_cost").alias("total_return_cost"),
                F.sum("lost_margin_cost").alias("total_lost_margin_cost"),
                F.sum("expected_margin").alias("total_margin"))
    return out.withColumn("returned_units", F.col("total_return_cost") / F.lit(float(return_cost_eur)))


# P3 / P4 / P5 ------------------------------------------------------------------
def policy_oracle(actual="actual_demand", safety: float = P.SAFETY_FACTOR) -> Column:
    return F.greatest(_c(actual) * F.lit(safety), F.lit(0.0))


def policy_naive(actual="actual_demand", key: str = "article_id", seed: int = P.RANDOM_SEED,
                 std: float = P.NAIVE_NOISE_STD, safety: float = P.SAFETY_FACTOR) -> Column:
    """Actual demand x N(1, std) x safety, clipped at 0; the draw is an md5
    function of the article key (reproducible on any partitioning)."""
    noise = normal([key], f"naive:{seed}", 1.0, std)
    return F.greatest(_c(actual) * noise * F.lit(safety), F.lit(0.0))


def policy_forecast(pred="predicted_demand", safety: float = P.SAFETY_FACTOR) -> Column:
    return F.greatest(_c(pred) * F.lit(safety), F.lit(0.0))


def with_policies(base: DataFrame) -> DataFrame:
    return base.select("*", policy_oracle().alias("prod_oracle"), policy_naive().alias("prod_naive"),
                       policy_forecast().alias("prod_forecast"))


# P6 -------------------------------------------------------------------------
def reallocate(base: DataFrame, budget: float, alphas: Sequence[float],
               g: float = P.GROSS_MARGIN_PCT, c: float = P.RETURN_HANDLING_COST_EUR,
               cap_factor: float = P.REALLOC_CAP, rounds: int = P.REALLOC_ROUNDS,
               floor: float = P.REALLOC_SCORE_FLOOR, pred: str = "predicted_demand",
               price: str = "avg_price_eur", p: str = "return_prob",
               store: bool = True) -> DataFrame:
    """Budget-constrained, capped reallocation for every α at once.

    score = max(price·g·(1-p) - p·c, floor); weight = ŷ·((1-α) + α·score/mean(score));
    cap = cap_factor·ŷ; production = min(budget·w/Σw, cap); then up to
    ``rounds`` times: leftover = budget - Σproduction, stop when < 1 or no row
    is below its cap, else spread the leftover over the rows below their cap
    by weight (capped again). Returns base columns + alpha + production.
    """
    score = F.greatest(_c(price) * F.lit(g) * (F.lit(1.0) - _c(p)) - _c(p) * F.lit(c), F.lit(floor))
    b = base.withColumn("_score", score)
    mean = b.agg(F.avg("_score").alias("_mean_score"))
    from .prefix import with_scalars
    b = with_scalars(b, mean)
    b = b.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    w = _c(pred) * ((F.lit(1.0) - F.col("alpha")) + F.col("alpha") * F.col("_score") / F.col("_mean_score"))
    b = b.withColumn("_w", w).withColumn("_cap", _c(pred) * F.lit(cap_factor)).drop("_score", "_mean_score")
    if store:
        b = stored(b, "reallocation")

    def per_alpha(values: Mapping[float, float]) -> Column:
        m = F.create_map(*[x for a, v in values.items() for x in (F.lit(float(a)), F.lit(float(v)))])
        return m[F.col("alpha")]

    tot_w = {r["alpha"]: r["s"] for r in b.groupBy("alpha").agg(F.sum("_w").alias("s")).collect()}
    prod = F.least(F.lit(float(budget)) * F.col("_w") / per_alpha(tot_w), F.col("_cap"))
    b = b.withColumn("production", prod)
    for _ in range(rounds):
        stats = (b.groupBy("alpha")
                  .agg(F.sum("production").alias("s"),
                       F.sum(F.when(F.col("production") < F.col("_cap"), F.col("_w"))).alias("fw"),
                       F.count_if(F.col("production") < F.col("_cap")).alias("nf"))
                  .collect())
        go = {}
        for r in stats:
            leftover = float(budget) - r["s"]
            if leftover >= 1 and r["nf"] > 0:
                go[r["alpha"]] = (leftover, r["fw"])
        if not go:
            break
        active = F.col("alpha").isin(*[F.lit(float(a)) for a in go])
        extra = (per_alpha({a: v[0] for a, v in go.items()}) * F.col("_w")
                 / per_alpha({a: v[1] for a, v in go.items()}))
        b = b.withColumn("production", F.when(active & (F.col("production") < F.col("_cap")),
                                              F.least(F.col("production") + extra, F.col("_cap")))
                         .otherwise(F.col("production")))
    return b.drop("_w", "_cap")


def total(df: DataFrame, col: str) -> float:
    """One scalar total (a single aggregate row)."""
    return float(df.agg(F.sum(col)).first()[0] or 0.0)


# P7 -------------------------------------------------------------------------
def evaluate_scenarios(df: DataFrame, scenarios: Mapping[str, str], demand: str = "actual_demand",
                       p: str = "return_prob", price: str = "avg_price_eur",
                       params: P.EconParams = P.EconParams()) -> DataFrame:
    """P1 with actual demand for each policy's quantity, then P2 per
    scenario. Policies are stacked by an explode (one row per article and
    scenario), so all scenarios cost one aggregate."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.col(c).cast("double").alias("_qty"))
                               for n, c in scenarios.items()])).alias("_s")
    stacked = df.select(demand, p, price, rows).select(demand, p, price, "_s.*")
    return portfolio_pnl(with_pnl(stacked, demand, "_qty", p, price, params), ["scenario"])


SCENARIO_NAMES = P.SCENARIO_NAMES


# P8 -------------------------------------------------------------------------
def compare_scenarios(summary: DataFrame) -> DataFrame:
    """Impact of the optimized policy against the naive one (and forecast,
    oracle), from the scenario totals; scenarios found by name prefix."""
    def pick(prefix: str, col: str) -> Column:
        return F.max(F.when(F.col("scenario").startswith(prefix), F.col(col)))

    agg = summary.agg(*[pick(pre, col).alias(f"{k}_{col}")
                        for k, pre in (("opt", "Optimized"), ("naive", "Naive"), ("fcst", "Forecast"),
                                       ("oracle", "Oracle"))
                        for col in ("total_margin", "total_return_cost", "total_unsold", "total_production")])

    def pct(a, b):
        return F.lit(100.0) * (F.col(a) - F.col(b)) / F.col(a)

    return agg.select(
        (F.col("opt_total_margin") - F.col("naive_total_margin")).alias("margin_uplift_eur"),
        ((F.col("opt_total_margin") / F.col("naive_total_margin") - F.lit(1.0)) * F.lit(100.0)).alias("margin_uplift_pct"),
        (F.col("opt_total_margin") - F.col("fcst_total_margin")).alias("margin_vs_forecast_eur"),
        (F.col("naive_total_return_cost") - F.col("opt_total_return_cost")).alias("returns_saved_eur"),
        (F.col("naive_total_unsold") - F.col("opt_total_unsold")).alias("unsold_saved_units"),
        pct("naive_total_production", "opt_total_production").alias("production_reduction_pct"),
        pct("naive_total_unsold", "opt_total_unsold").alias("unsold_reduction_pct"),
        pct("naive_total_return_cost", "opt_total_return_cost").alias("return_cost_reduction_pct"),
        (F.col("oracle_total_margin") - F.col("opt_total_margin")).alias("gap_to_oracle_eur"))


# P9 -------------------------------------------------------------------------
def alpha_sweep(base: DataFrame, budget: float, alphas: Sequence[float] = P.ALPHA_GRID,
                params: P.EconParams = P.EconParams()) -> DataFrame:
    """Margin, production, unsold and return cost (millions) per α, and the
    best α (max margin, first on ties)."""
    r = reallocate(base, budget, alphas, params.gross_margin, params.return_cost)
    tot = portfolio_pnl(with_pnl(r, "actual_demand", "production", "return_prob", "avg_price_eur", params),
                        ["alpha"])
    sweep = tot.select("alpha", (F.col("total_margin") / 1e6).alias("margin_M"),
                       (F.col("total_production") / 1e6).alias("production_M"),
                       (F.col("total_unsold") / 1e6).alias("unsold_M"),
                       (F.col("total_return_cost") / 1e6).alias("return_cost_M"))
    best = sweep.agg(F.max_by("alpha", F.struct(F.col("margin_M"), -F.col("alpha"))).alias("best_alpha"))
    from .prefix import with_scalars
    return with_scalars(sweep, best)


# P10 ------------------------------------------------------------------------
def with_reallocation_delta(df: DataFrame, naive: str = "prod_naive", opt: str = "prod_optimized",
                            p: str = "return_prob", price: str = "avg_price_eur",
                            c: float = P.RETURN_HANDLING_COST_EUR,
                            d: float = P.UNSOLD_DESTRUCTION_RATE) -> DataFrame:
    diff = F.col(naive) - F.col(opt)
    return (df.withColumn("production_diff", diff)
              .withColumn("production_diff_pct",
                          F.coalesce(F.try_divide(F.col("production_diff"), F.when(F.col(naive) != 0, F.col(naive)))
                                     * F.lit(100.0), F.lit(0.0)))
              .withColumn("margin_saved_eur",
                          F.col("production_diff") * F.col(p) * F.lit(c)
                          + F.greatest(F.col("production_diff"), F.lit(0.0)) * F.col(price) * F.lit(d)))


# P11 ------------------------------------------------------------------------
def what_if_sums(df: DataFrame, qty: str, demand: str = "actual_demand", p: str = "return_prob",
                 price: str = "avg_price_eur") -> DataFrame:
    """The nine sums over articles that the totals of any (g, c, m, d) are
    made of: for fixed quantities each P&L total is a polynomial in them."""
    q, dem, pr, pe = _c(qty), _c(demand), _c(p), _c(price)
    sold, unsold, lost = F.least(dem, q), F.greatest(q - dem, F.lit(0.0)), F.greatest(dem - q, F.lit(0.0))
    sums = {"made": q, "sold": sold, "unsold": unsold, "lost": lost, "sold_value": sold * pe, "unsold_value": unsold * pe,
            "lost_value": lost * pe, "made_value": q * pe, "returned": sold * pr}
    return df.agg(*[F.sum(v.cast("double")).alias(f"_{k}") for k, v in sums.items()])


def what_if(df: DataFrame, grid: DataFrame | Sequence[Mapping[str, float]], qty: str, demand: str = "actual_demand",
            p: str = "return_prob", price: str = "avg_price_eur") -> DataFrame:
    """Exact P1 + P2 for every parameter row (g, c, m, d) of any grid: one
    aggregate over the articles, then arithmetic on the grid's rows."""
    from .prefix import with_scalars
    if not isinstance(grid, DataFrame):
        grid = df.sparkSession.createDataFrame([tuple(float(r[k]) for k in "gcmd") for r in grid],
                                               "g double, c double, m double, d double")
    x = with_scalars(grid.select("g", "c", "m", "d"), what_if_sums(df, qty, demand, p, price))
    g, c, m, d = (F.col(k) for k in "gcmd")
    one = F.lit(1.0)
    markdown, destroyed = F.col("_unsold") * (one - d), F.col("_unsold") * d
    revenue = F.col("_sold_value") + F.col("_unsold_value") * (one - d) * (one - m)
    returns, lost_margin = F.col("_returned") * c, F.col("_lost_value") * g
    costs = F.col("_made_value") * (one - g) + returns + F.col("_unsold_value") * d * (one - g) + lost_margin
    return x.select("g", "c", "m", "d", F.col("_made").alias("total_production"), F.col("_sold").alias("total_sold_full"),
                    (markdown + destroyed).alias("total_unsold"), F.col("_lost").alias("total_lost_demand"),
                    revenue.alias("total_revenue"), returns.alias("total_return_cost"), lost_margin.alias("total_lost_margin_cost"),
                    (revenue - costs).alias("total_margin"), (returns / c).alias("returned_units"))


# P12 ------------------------------------------------------------------------
def policy_conservative(df: DataFrame, base_qty: str = "prod_forecast", p: str = "return_prob",
                        top: float = 0.10, cut: float = 0.20, name: str = "prod_conservative") -> DataFrame:
    """Cut ``base_qty`` by ``cut`` on the riskiest ``top`` share of products
    (return probability at or above its exact (1 - top) quantile)."""
    from .prefix import percentile_row, with_scalars
    q = percentile_row(df, p, {"_risk_cut": 1.0 - top})
    out = with_scalars(df, q)
    return out.withColumn(name, F.when(F.col(p) >= F.col("_risk_cut"), F.col(base_qty) * F.lit(1.0 - cut))
                          .otherwise(F.col(base_qty))).drop("_risk_cut")


# P13 ------------------------------------------------------------------------
def policy_discount(pred="predicted_demand", p="return_prob", alpha: float = 0.5) -> Column:
    """Demand discounted by expected returns: ŷ x (1 - α·p)."""
    return _c(pred) * (F.lit(1.0) - F.lit(alpha) * _c(p))
