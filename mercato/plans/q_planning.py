"""Registered queries: production planning (A9, J4, P1-P13, T-c, T-d, S8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..functions import columns as FC
from ..functions.random import sql_normal
from ..operators import planning as PL
from ..operators import topk as K
from ..sources import io
from ..sources.standin import sql_with
from . import planning as PP
from .catalog import ORACLE, R, query
from .q_forecast import PRED_BODY
from .q_returns import LT_BODY
from .stage_jobs import Stages

VE = P.STANDIN_VAL_END
G, C, M, D = P.GROSS_MARGIN_PCT, P.RETURN_HANDLING_COST_EUR, P.MARKDOWN_DISCOUNT_PCT, P.UNSOLD_DESTRUCTION_RATE


def dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


PLAN_CTE = sql_with("transactions", "transactions_c", "articles", "customers") + PRED_BODY + LT_BODY + f""",
dem AS (SELECT article_id, sum(CAST(units_sold AS DOUBLE)) AS actual_demand, sum(y_pred) AS predicted_demand,
               avg(avg_price) AS avg_price FROM pred GROUP BY 1),
risk AS (SELECT article_id, avg(return_prob_clean) AS return_prob FROM test GROUP BY 1),
base AS (SELECT dem.article_id, actual_demand, predicted_demand, avg_price, avg_price * {dbl(P.PRICE_TO_EUR)} AS avg_price_eur,
                risk.return_prob FROM dem JOIN risk ON dem.article_id = risk.article_id),
pol AS (SELECT *, greatest(actual_demand * {dbl(P.SAFETY_FACTOR)}, 0.0) AS prod_oracle,
               greatest(actual_demand * {sql_normal(['article_id'], f'naive:{P.RANDOM_SEED}', 1.0, P.NAIVE_NOISE_STD)} * {dbl(P.SAFETY_FACTOR)}, 0.0) AS prod_naive,
               greatest(predicted_demand * {dbl(P.SAFETY_FACTOR)}, 0.0) AS prod_forecast FROM base),
bud AS (SELECT sum(prod_oracle) AS budget FROM pol)"""


def pnl_sql(d: str, q: str, p: str, price: str, g=G, c=C, m=M, dd=D) -> dict[str, str]:
    """DuckDB text of the twelve P1 columns, same operation order as Spark."""
    num = all(isinstance(v, (int, float)) for v in (g, c, m, dd))
    lit = dbl if num else (lambda x: x)
    om = (lambda x: dbl(1.0 - float(x))) if num else (lambda x: f"(1.0 - {x})")
    sold = f"least({d}, {q})"
    unsold = f"greatest({q} - {d}, 0.0)"
    md = f"({unsold} * {om(dd)})"
    destroyed = f"({unsold} * {lit(dd)})"
    lost = f"greatest({d} - {q}, 0.0)"
    lm = f"({lost} * {price} * {lit(g)})"
    rf = f"({sold} * {price})"
    rm = f"({md} * {price} * {om(m)})"
    cogs = f"({q} * {price} * {om(g)})"
    rc = f"({sold} * {p} * {lit(c)})"
    dc = f"({destroyed} * {price} * {om(g)})"
    margin = f"({rf} + {rm} - {cogs} - {rc} - {dc} - {lm})"
    return dict(zip(PL.PNL_COLS, [q, sold, md, destroyed, lost, rf, rm, cogs, rc, dc, lm, margin]))


def totals_sql(pnl: dict[str, str]) -> str:
    return (f"sum({pnl['production_qty']}) AS total_production, sum({pnl['sold_full_price']}) AS total_sold_full, "
            f"sum({pnl['sold_at_markdown']}) + sum({pnl['destroyed']}) AS total_unsold, "
            f"sum({pnl['lost_demand']}) AS total_lost_demand, "
            f"sum({pnl['revenue_full']}) + sum({pnl['revenue_markdown']}) AS total_revenue, "
            f"sum({pnl['return_cost']}) AS total_return_cost, sum({pnl['lost_margin_cost']}) AS total_lost_margin_cost, "
            f"sum({pnl['expected_margin']}) AS total_margin")


TOTAL_COLS = ["total_production", "total_sold_full", "total_unsold", "total_lost_demand", "total_revenue",
              "total_return_cost", "total_lost_margin_cost", "total_margin"]


def realloc_sql(alphas, src: str = "pol", out: str = "ra") -> str:
    """CTEs of the capped reallocation for every α (the SQL twin of
    ``planning.reallocate``); the last CTE is named ``out``."""
    arr = "[" + ", ".join(dbl(a) for a in alphas) + "]"
    parts = [
        f"sc AS (SELECT *, greatest(avg_price_eur * {dbl(G)} * (1.0 - return_prob) - return_prob * {dbl(C)}, "
        f"{dbl(P.REALLOC_SCORE_FLOOR)}) AS _score FROM {src})",
        f"ex AS (SELECT sc.*, al.alpha, predicted_demand * ((1.0 - al.alpha) + al.alpha * _score / "
        f"(SELECT avg(_score) FROM sc)) AS _w, predicted_demand * {dbl(P.REALLOC_CAP)} AS _cap "
        f"FROM sc, (SELECT unnest({arr}) AS alpha) al)",
        "r0 AS (SELECT *, least((SELECT budget FROM bud) * _w / sum(_w) OVER (PARTITION BY alpha), _cap) AS production FROM ex)",
    ]
    for k in range(1, P.REALLOC_ROUNDS + 1):
        parts.append(
            f"s{k} AS (SELECT *, (SELECT budget FROM bud) - sum(production) OVER (PARTITION BY alpha) AS _lo, "
            f"sum(CASE WHEN production < _cap THEN _w END) OVER (PARTITION BY alpha) AS _fw, "
            f"count(*) FILTER (WHERE production < _cap) OVER (PARTITION BY alpha) AS _nf FROM r{k - 1})")
        parts.append(
            f"r{k} AS (SELECT * EXCLUDE (production, _lo, _fw, _nf), CASE WHEN _lo >= 1 AND _nf > 0 AND production < _cap "
            f"THEN least(production + _lo * _w / _fw, _cap) ELSE production END AS production FROM s{k})")
    parts.append(f"{out} AS (SELECT * EXCLUDE (_score, _w, _cap) FROM r{P.REALLOC_ROUNDS})")
    return ",\n" + ",\n".join(parts)


def _policies(spark, sf_dir):
    return Stages(spark, sf_dir).policies()


def _plan(spark, sf_dir):
    return Stages(spark, sf_dir).per_article()


PLAN_OPT = PLAN_CTE + realloc_sql([P.ALPHA_OPTIMAL]) + """,
plan0 AS (SELECT * EXCLUDE (alpha, production), production AS prod_optimized FROM ra),
plan AS (SELECT *, prod_naive - prod_optimized AS production_diff,
                coalesce((prod_naive - prod_optimized) / nullif(prod_naive, 0) * 100.0, 0.0) AS production_diff_pct,
                (prod_naive - prod_optimized) * return_prob * 18.0
                  + greatest(prod_naive - prod_optimized, 0.0) * avg_price_eur * 0.15 AS margin_saved_eur FROM plan0)"""


@query("planning_base", PLAN_CTE + f"""
SELECT article_id, {R('actual_demand')} AS actual_demand, {R('predicted_demand')} AS predicted_demand,
       {R('avg_price')} AS avg_price, {R('avg_price_eur')} AS avg_price_eur, {R('return_prob')} AS return_prob FROM base""")
def q_planning_base(spark, sf_dir):
    """A9 + J4 + C16: per-article planning table, from the stages of demand
    and risk, joined bucket by bucket."""
    return Stages(spark, sf_dir).planning_base()


@query("policies", PLAN_CTE + f"""
SELECT article_id, {R('prod_oracle')} AS prod_oracle, {R('prod_naive')} AS prod_naive,
       {R('prod_forecast')} AS prod_forecast FROM pol""")
def q_policies(spark, sf_dir):
    """P3 + P4 + P5: oracle, naive (md5-seeded noise) and forecast policies."""
    return _policies(spark, sf_dir).select("article_id", "prod_oracle", "prod_naive", "prod_forecast")


_PNL_F = pnl_sql("actual_demand", "prod_forecast", "return_prob", "avg_price_eur")


@query("pnl_per_article", PLAN_CTE + "\nSELECT article_id, " + ", ".join(
    f"{R(v)} AS {k}" for k, v in _PNL_F.items()) + " FROM pol")
def q_pnl_per_article(spark, sf_dir):
    """Twelve P&L columns per article (forecast policy, actual demand)."""
    b = _policies(spark, sf_dir)
    return PL.with_pnl(b, "actual_demand", "prod_forecast", "return_prob", "avg_price_eur").select(
        "article_id", *PL.PNL_COLS)


@query("portfolio_pnl", PLAN_CTE + f""",
t AS (SELECT {totals_sql(_PNL_F)} FROM pol)
SELECT {", ".join(f"{R(c)} AS {c}" for c in TOTAL_COLS)}, {R('total_return_cost / 18.0')} AS returned_units FROM t""")
def q_portfolio_pnl(spark, sf_dir):
    """Portfolio totals of the forecast policy."""
    b = _policies(spark, sf_dir)
    return PL.portfolio_pnl(PL.with_pnl(b, "actual_demand", "prod_forecast", "return_prob", "avg_price_eur"))


@query("reallocation", PLAN_OPT + f"""
SELECT article_id, {R('prod_optimized')} AS prod_optimized FROM plan""")
def q_reallocation(spark, sf_dir):
    """P6 at α = 0.1: budget-constrained capped reallocation."""
    return _plan(spark, sf_dir).select("article_id", "prod_optimized")


@query("reallocation_alpha1", PLAN_CTE + realloc_sql([1.0]) + f"""
SELECT article_id, {R('production')} AS production FROM ra""")
def q_reallocation_alpha1(spark, sf_dir):
    """P6 at α = 1.0, where caps bind and the redistribution rounds run."""
    b = _policies(spark, sf_dir)
    return PL.reallocate(b, PL.total(b, "prod_oracle"), [1.0]).select("article_id", "production")


def _scen_sql_rows():
    rows = []
    for col, name in PL.SCENARIO_NAMES.items():
        t = totals_sql(pnl_sql("actual_demand", col, "return_prob", "avg_price_eur"))
        rows.append(f"SELECT '{name}' AS scenario, {t} FROM plan")
    return " UNION ALL ".join(rows)


SCEN_SQL = PLAN_OPT + f""",
scen AS ({_scen_sql_rows()})"""


@query("scenario_pnl", SCEN_SQL + f"""
SELECT scenario, {", ".join(f"{R(c)} AS {c}" for c in TOTAL_COLS)}, {R('total_return_cost / 18.0')} AS returned_units
FROM scen""")
def q_scenario_pnl(spark, sf_dir):
    """P&L totals of the four policies under actual demand."""
    return Stages(spark, sf_dir).pnl_summary()


def _pick(pre, col):
    return f"max(CASE WHEN starts_with(scenario, '{pre}') THEN {col} END)"


@query("scenario_comparison", SCEN_SQL + f""",
k AS (SELECT {_pick('Optimized', 'total_margin')} AS om, {_pick('Naive', 'total_margin')} AS nm,
             {_pick('Forecast', 'total_margin')} AS fm, {_pick('Oracle', 'total_margin')} AS orm,
             {_pick('Optimized', 'total_return_cost')} AS orc, {_pick('Naive', 'total_return_cost')} AS nrc,
             {_pick('Optimized', 'total_unsold')} AS ou, {_pick('Naive', 'total_unsold')} AS nu,
             {_pick('Optimized', 'total_production')} AS op, {_pick('Naive', 'total_production')} AS np FROM scen)
SELECT {R('om - nm')} AS margin_uplift_eur, {R('(om / nm - 1.0) * 100.0')} AS margin_uplift_pct,
       {R('om - fm')} AS margin_vs_forecast_eur, {R('nrc - orc')} AS returns_saved_eur, {R('nu - ou')} AS unsold_saved_units,
       {R('100.0 * (np - op) / np')} AS production_reduction_pct, {R('100.0 * (nu - ou) / nu')} AS unsold_reduction_pct,
       {R('100.0 * (nrc - orc) / nrc')} AS return_cost_reduction_pct, {R('orm - om')} AS gap_to_oracle_eur FROM k""")
def q_scenario_comparison(spark, sf_dir):
    """Margin uplift, savings and gap to the oracle."""
    return PL.compare_scenarios(Stages(spark, sf_dir).pnl_summary())


_PNL_SWEEP = pnl_sql("actual_demand", "production", "return_prob", "avg_price_eur")


@query("alpha_sweep", PLAN_CTE + realloc_sql(P.ALPHA_GRID) + f""",
t AS (SELECT alpha, {totals_sql(_PNL_SWEEP)} FROM ra GROUP BY alpha),
sw AS (SELECT alpha, total_margin / 1e6 AS margin_M, total_production / 1e6 AS production_M,
              total_unsold / 1e6 AS unsold_M, total_return_cost / 1e6 AS return_cost_M FROM t)
SELECT {R('alpha')} AS alpha, {R('margin_M')} AS margin_M, {R('production_M')} AS production_M,
       {R('unsold_M')} AS unsold_M, {R('return_cost_M')} AS return_cost_M,
       {R('(SELECT alpha FROM sw ORDER BY margin_M DESC, alpha LIMIT 1)')} AS best_alpha FROM sw""")
def q_alpha_sweep(spark, sf_dir):
    """α sweep over 11 points with the best α."""
    return Stages(spark, sf_dir).sensitivity()


@query("reallocation_delta", PLAN_OPT + f"""
SELECT article_id, {R('prod_naive')} AS prod_naive, {R('prod_optimized')} AS prod_optimized,
       {R('production_diff')} AS production_diff, {R('production_diff_pct')} AS production_diff_pct,
       {R('margin_saved_eur')} AS margin_saved_eur FROM plan""")
def q_reallocation_delta(spark, sf_dir):
    """P10: naive -> optimized production change and saved value."""
    return _plan(spark, sf_dir).select("article_id", "prod_naive", "prod_optimized", "production_diff",
                                       "production_diff_pct", "margin_saved_eur")


TOP_COLS = ["article_id", "actual_demand", "predicted_demand", "return_prob", "avg_price_eur", "prod_naive",
            "prod_optimized", "production_diff", "production_diff_pct", "margin_saved_eur"]


def _sel_r(cols):
    return ", ".join(c if c == "article_id" else f"{R(c)} AS {c}" for c in cols)


@query("top_reallocations", PLAN_OPT + f"""
SELECT {_sel_r(TOP_COLS)} FROM (SELECT * FROM plan ORDER BY margin_saved_eur DESC, article_id LIMIT 20)""")
def q_top_reallocations(spark, sf_dir):
    """T-c: 20 articles with the most reallocation value."""
    return Stages(spark, sf_dir).top20().select(*TOP_COLS)


@query("top_changes", PLAN_OPT + f"""
SELECT {_sel_r(TOP_COLS)} FROM (SELECT * FROM plan ORDER BY abs(production_diff) DESC, article_id LIMIT 10)""")
def q_top_changes(spark, sf_dir):
    """T-d: 10 articles by absolute production change."""
    p = _plan(spark, sf_dir).withColumn("_abs", F.abs("production_diff"))
    return K.top_k(p, 10, "_abs").select(*TOP_COLS)


WHAT_IF_GRID = [
    {"g": 0.53, "c": 18.0, "m": 0.40, "d": 0.15},
    {"g": 0.50, "c": 12.0, "m": 0.30, "d": 0.10},
    {"g": 0.55, "c": 25.0, "m": 0.50, "d": 0.25},
]


def _what_if_sql():
    rows = []
    for r in WHAT_IF_GRID:
        pnl = pnl_sql("actual_demand", "prod_forecast", "return_prob", "avg_price_eur",
                      dbl(r["g"]), dbl(r["c"]), dbl(r["m"]), dbl(r["d"]))
        rows.append(f"SELECT {dbl(r['g'])} AS g, {dbl(r['c'])} AS c, {dbl(r['m'])} AS m, {dbl(r['d'])} AS d, "
                    f"{totals_sql(pnl)}, sum({pnl['return_cost']}) / {dbl(r['c'])} AS returned_units FROM pol")
    return " UNION ALL ".join(rows)


@query("what_if", PLAN_CTE + f""",
w AS ({_what_if_sql()})
SELECT {R('g')} AS g, {R('c')} AS c, {R('m')} AS m, {R('d')} AS d,
       {", ".join(f"{R(c)} AS {c}" for c in TOTAL_COLS)}, {R('returned_units')} AS returned_units FROM w""")
def q_what_if(spark, sf_dir):
    """Exact P&L recomputation for a grid of economic parameters."""
    return PL.what_if(_policies(spark, sf_dir), WHAT_IF_GRID, "prod_forecast")


_PNL_CONS = pnl_sql("actual_demand", "prod_conservative", "return_prob", "avg_price_eur")
_PNL_DISC = pnl_sql("actual_demand", "prod_discount", "return_prob", "avg_price_eur")


@query("declared_policies", PLAN_CTE + f""",
cut AS (SELECT quantile_cont(return_prob, 0.9) AS q FROM pol),
x AS (SELECT *, CASE WHEN return_prob >= (SELECT q FROM cut) THEN prod_forecast * {dbl(0.8)} ELSE prod_forecast END
                  AS prod_conservative,
             predicted_demand * (1.0 - {dbl(0.5)} * return_prob) AS prod_discount FROM pol)
SELECT 'conservative' AS scenario, {R('sum(prod_conservative)')} AS total_production, {R('sum(' + _PNL_CONS['expected_margin'] + ')')} AS total_margin FROM x
UNION ALL
SELECT 'discount', {R('sum(prod_discount)')}, {R('sum(' + _PNL_DISC['expected_margin'] + ')')} FROM x""")
def q_declared_policies(spark, sf_dir):
    """P12 + P13: conservative cut on the riskiest 10 % and the
    return-discounted policy, evaluated with P1 + P2."""
    b = _policies(spark, sf_dir)
    b = PL.policy_conservative(b, "prod_forecast", "return_prob", 0.10, 0.20)
    b = b.withColumn("prod_discount", PL.policy_discount("predicted_demand", "return_prob", 0.5))
    s = PL.evaluate_scenarios(b, {"conservative": "prod_conservative", "discount": "prod_discount"})
    return s.select("scenario", "total_production", "total_margin")


def _nested_summary(spark, sf_dir):
    stages = Stages(spark, sf_dir)
    return PP.executive_summary(stages.per_article(), stages.sensitivity())


def _long(section: str, item: str, sql: str, drop: tuple[str, ...] = ()) -> str:
    keep = f"* EXCLUDE ({', '.join(drop)})" if drop else "*"
    return (f"SELECT '{section}' AS section, {item} AS item, metric, value FROM "
            f"(UNPIVOT ({sql}) ON COLUMNS({keep}) INTO NAME metric VALUE value)")


_ASSUMED = {"gross_margin_pct": G, "return_handling_cost_eur": C, "markdown_pct": M, "destruction_rate": D,
            "price_to_eur_factor": P.PRICE_TO_EUR}
SUMMARY_SQL = " UNION ALL ".join([
    _long("scenario", "scenario", ORACLE["scenario_pnl"], ("scenario",)),
    _long("impact", "''", f"SELECT * EXCLUDE (gap_to_oracle_eur) FROM ({ORACLE['scenario_comparison']})"),
    _long("sensitivity", "CAST(alpha AS VARCHAR)", f"SELECT * EXCLUDE (best_alpha) FROM ({ORACLE['alpha_sweep']})", ("alpha",)),
    _long("summary", "''", f"SELECT {dbl(P.ALPHA_OPTIMAL)} AS alpha_optimal, gap_to_oracle_eur, "
          f"(SELECT max(best_alpha) FROM ({ORACLE['alpha_sweep']})) AS best_alpha, "
          f"(SELECT {R('sum(prod_oracle)')} FROM ({PLAN_CTE} SELECT prod_oracle FROM pol)) AS budget_units "
          f"FROM ({ORACLE['scenario_comparison']})"),
    _long("assumptions", "''", "SELECT " + ", ".join(f"{dbl(v)} AS {k}" for k, v in _ASSUMED.items())),
])


@query("executive_summary", SUMMARY_SQL)
def q_executive_summary(spark, sf_dir):
    """Executive summary (scenarios, impact, sensitivity, assumptions),
    its nested row as section / item / metric / value rows."""
    return PP.summary_rows(_nested_summary(spark, sf_dir))


_EXPORT_SQL = """
SELECT article_id AS "Article ID", round_even(avg_price_eur, 2) AS "Price (€)", round_even(return_prob, 3) AS "Return prob",
       CAST(round_even(prod_naive, 0) AS BIGINT) AS "Naive units", CAST(round_even(prod_optimized, 0) AS BIGINT) AS "Optim units",
       CAST(round_even(production_diff, 0) AS BIGINT) AS "Δ units", round_even(margin_saved_eur, 2) AS "Margin saved (€)"
FROM (SELECT * FROM plan ORDER BY abs(production_diff) DESC, article_id LIMIT 10)"""


@query("top_changes_export", PLAN_OPT + _EXPORT_SQL)
def q_top_changes_export(spark, sf_dir):
    """T-d + C21: the top-10 reallocation table as exported."""
    p = _plan(spark, sf_dir).withColumn("_abs", F.abs("production_diff"))
    units = {"prod_naive": "Naive units", "prod_optimized": "Optim units", "production_diff": "Δ units"}
    out = FC.export_view(K.top_k(p, 10, "_abs"), {"article_id": "Article ID"},
                         round_cols={"avg_price_eur": ("Price (€)", 2), "return_prob": ("Return prob", 3),
                                     **{k: (v, 0) for k, v in units.items()}, "margin_saved_eur": ("Margin saved (€)", 2)})
    return out.withColumns({v: F.col(f"`{v}`").cast("long") for v in units.values()})


ORACLE["metrics_json_roundtrip"] = SUMMARY_SQL  # the same rows, through a JSON file


@query("scored_planning_base")
def q_scored_planning_base(spark, sf_dir):
    """M8 + M9 -> A9 + J4: the planning table on the fitted models' stored
    scores instead of the deterministic prediction."""
    return Stages(spark, sf_dir).planning_base(scores=True)


@query("scored_scenario_pnl")
def q_scored_scenario_pnl(spark, sf_dir):
    """P3-P7 on the models' scores: totals of the four policies."""
    return Stages(spark, sf_dir).pnl_summary(scores=True)


@query("stage_tables", sql_with("transactions", "transactions_c", "articles", "customers") + PRED_BODY + LT_BODY + f""",
weekly_rows AS (SELECT count(*) AS n FROM (SELECT DISTINCT article_id, date_trunc('week', t_dat) FROM transactions)),
risk_rows AS (SELECT count(DISTINCT article_id) AS n FROM test),
sold AS (SELECT count(*) AS n FROM articles WHERE article_id IN (SELECT article_id FROM transactions)),
both_rows AS (SELECT count(*) AS n FROM (SELECT DISTINCT article_id FROM pred) p WHERE article_id IN (SELECT article_id FROM test))
SELECT 'weekly_sales' AS table_name, (SELECT n FROM weekly_rows) AS n_rows, 4::BIGINT AS n_cols
UNION ALL SELECT 'article_features', (SELECT n FROM sold), 11
UNION ALL SELECT 'demand_predictions', (SELECT count(*) FROM pred), 5
UNION ALL SELECT 'return_predictions', (SELECT n FROM risk_rows), 4
UNION ALL SELECT 'article_clusters', (SELECT count(*) FROM articles), 2
UNION ALL SELECT 'simulator_per_article', (SELECT n FROM both_rows), 13
UNION ALL SELECT 'simulator_pnl_summary', 4, 10
UNION ALL SELECT 'simulator_sensitivity', {len(P.ALPHA_GRID)}, 6
UNION ALL SELECT 'simulator_top20_reassign', (SELECT least(n, 20) FROM both_rows), 13""")
def q_stage_tables(spark, sf_dir):
    """S4 + S6 + S9: the whole stage pipeline, profiled as it is read back."""
    return io.table_profile(Stages(spark, sf_dir).run())
