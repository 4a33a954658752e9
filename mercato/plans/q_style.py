"""Registered queries: style and risk reporting marts
(J5, A10-A12, A14, F7-F9, R3, T-f, C21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..functions import columns as C
from ..operators import aggregates as A
from ..operators import filters as Fi
from ..operators import topk as K
from ..sources.standin import sql_with
from .catalog import R, query
from .q_returns import LT_BODY, SQL_RISK
from .stage_jobs import Stages

VE = P.STANDIN_VAL_END
TOP_AXES = {"garment_group_name": 12, "colour_group_name": 15}

STYLE_CTE = sql_with("transactions_c", "articles", "customers") + LT_BODY + f""",
r AS ({SQL_RISK}),
sb AS (SELECT r.*, a.* EXCLUDE (article_id) FROM r LEFT JOIN articles a ON r.article_id = a.article_id)"""


def _style(spark, sf_dir):
    return Stages(spark, sf_dir).style_base()


def _clustered(spark, sf_dir):
    return Stages(spark, sf_dir).style_base(clusters=True)


def _top_sql(col, n):
    return (f"(SELECT {col} FROM sb WHERE {col} IS NOT NULL GROUP BY 1 "
            f"ORDER BY count(*) DESC, {col} LIMIT {n})")


@query("style_base", STYLE_CTE + f"""
SELECT article_id, {R('avg_return_prob')} AS avg_return_prob, n_transactions, garment_group_name,
       colour_group_name, department_name, index_group_name FROM sb""")
def q_style_base(spark, sf_dir):
    """Article risk left-joined with article features."""
    return _style(spark, sf_dir).select("article_id", "avg_return_prob", "n_transactions", "garment_group_name",
                                        "colour_group_name", "department_name", "index_group_name")


@query("risk_matrix", STYLE_CTE + f""",
sub AS (SELECT * FROM sb WHERE garment_group_name IN {_top_sql('garment_group_name', 12)}
                         AND colour_group_name IN {_top_sql('colour_group_name', 15)})
SELECT garment_group_name, colour_group_name, {R('avg(avg_return_prob)')} AS return_rate, count(*) AS n
FROM sub GROUP BY 1, 2 HAVING count(*) >= 20""")
def q_risk_matrix(spark, sf_dir):
    """F9 + A10 + F7: garment x colour mean risk over the top 12 garments
    and top 15 colours, cells with >= 20 articles."""
    return A.risk_matrix(Fi.top_categories_filter(_style(spark, sf_dir), TOP_AXES), min_n=20)


@query("risk_heatmap", STYLE_CTE + f""",
sub AS (SELECT * FROM sb WHERE garment_group_name IN {_top_sql('garment_group_name', 12)}
                         AND colour_group_name IN {_top_sql('colour_group_name', 15)}),
cells AS (SELECT garment_group_name, colour_group_name, avg(avg_return_prob) AS return_rate
          FROM sub GROUP BY 1, 2 HAVING count(*) >= 20)
SELECT g.garment_group_name, c.colour_group_name, {R('cells.return_rate')} AS return_rate
FROM (SELECT DISTINCT garment_group_name FROM cells) g
CROSS JOIN {_top_sql('colour_group_name', 15)} c
LEFT JOIN cells ON cells.garment_group_name = g.garment_group_name AND cells.colour_group_name = c.colour_group_name""")
def q_risk_heatmap(spark, sf_dir):
    """The risk matrix pivoted to garments x colours (explicit column
    list = the top colours, collected as at most 15 values), read as one row
    per cell, empty cells included."""
    s = _style(spark, sf_dir)
    colours = [r[0] for r in Fi.top_categories(s, "colour_group_name", 15).collect()]
    cells = A.risk_matrix(Fi.top_categories_filter(s, TOP_AXES), min_n=20)
    wide = K.pivot_matrix(cells, "garment_group_name", "colour_group_name", "return_rate", sorted(colours))
    return wide.unpivot(["garment_group_name"], sorted(colours), "colour_group_name", "return_rate")


@query("category_tiers", STYLE_CTE + f""",
g AS (SELECT garment_group_name, count(*) AS n_products, avg(avg_return_prob) AS return_rate
      FROM sb WHERE garment_group_name IS NOT NULL GROUP BY 1 HAVING count(*) >= 30
      ORDER BY return_rate DESC, garment_group_name LIMIT 15)
SELECT garment_group_name, n_products, {R('return_rate')} AS return_rate,
       CASE WHEN return_rate < 0.15 THEN 'low' WHEN return_rate < 0.25 THEN 'mid' ELSE 'high' END AS tier FROM g""")
def q_category_tiers(spark, sf_dir):
    """A11 + C19: the riskiest garment groups with their category tier."""
    g = A.risk_by_garment(_style(spark, sf_dir))
    return g.withColumn("tier", C.risk_tier("return_rate", P.CATEGORY_TIER_BOUNDS))


@query("risk_by_garment", STYLE_CTE + f"""
SELECT garment_group_name, count(*) AS n_products, {R('avg(avg_return_prob)')} AS return_rate
FROM sb WHERE garment_group_name IS NOT NULL GROUP BY 1 HAVING count(*) >= 30
ORDER BY avg(avg_return_prob) DESC, garment_group_name LIMIT 15""")
def q_risk_by_garment(spark, sf_dir):
    """Garment groups with >= 30 products, the 15 riskiest."""
    return A.risk_by_garment(_style(spark, sf_dir))


def _mode_sql(col, key="index_group_name"):
    return (f"(SELECT {col} FROM (SELECT {key} AS k, {col}, row_number() OVER (PARTITION BY {key} "
            f"ORDER BY count(*) DESC, {col}) AS rn FROM sb WHERE {col} IS NOT NULL AND {key} IS NOT NULL "
            f"GROUP BY {key}, {col}) m WHERE rn = 1 AND m.k = g.{key})")


@query("segment_profile", STYLE_CTE + f"""
SELECT index_group_name, count(*) AS n_products, {R('avg(avg_return_prob)')} AS return_rate,
       coalesce({_mode_sql('garment_group_name')}, 'N/A') AS top_garment,
       coalesce({_mode_sql('colour_group_name')}, 'N/A') AS top_color,
       coalesce({_mode_sql('department_name')}, 'N/A') AS top_dept
FROM sb g WHERE index_group_name IS NOT NULL GROUP BY index_group_name""")
def q_segment_profile(spark, sf_dir):
    """Per-segment size, mean risk and modal garment / colour /
    department (lowest value on ties; grouped by index group — the MLlib
    cluster version is ``style_cluster_profile``)."""
    return A.cluster_profile(_style(spark, sf_dir), cluster="index_group_name")


@query("style_kpis", STYLE_CTE + f"""
SELECT count(*) AS n_articles, {R('avg(avg_return_prob)')} AS mean_risk,
       count(DISTINCT index_group_name) AS n_clusters,
       count(*) FILTER (WHERE avg_return_prob > 0.30) AS n_high_risk,
       {R('100.0 * count(*) FILTER (WHERE avg_return_prob > 0.30) / count(*)')} AS pct_high_risk FROM sb""")
def q_style_kpis(spark, sf_dir):
    """A14 + C19: catalogue KPIs; 'high risk' is strictly above 30 %."""
    return A.style_kpis(_style(spark, sf_dir), cluster="index_group_name")


@query("top_risk_in_group", STYLE_CTE + f""",
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY garment_group_name ORDER BY avg_return_prob DESC, article_id) AS INTEGER) AS rank
      FROM sb WHERE garment_group_name IS NOT NULL)
SELECT garment_group_name, article_id, colour_group_name, department_name, {R('avg_return_prob')} AS avg_return_prob, rank
FROM k WHERE rank <= 10""")
def q_top_risk_in_group(spark, sf_dir):
    """T-f: the 10 riskiest articles within every garment group."""
    s = _style(spark, sf_dir)
    return K.top_k_in_group(s, 10, "garment_group_name", "avg_return_prob").select(
        "garment_group_name", "article_id", "colour_group_name", "department_name", "avg_return_prob", "rank")


@query("garment_drilldown", STYLE_CTE + f"""
SELECT article_id, {R('avg_return_prob')} AS avg_return_prob, colour_group_name FROM sb WHERE garment_group_name = 'bolt'""")
def q_garment_drilldown(spark, sf_dir):
    """F8: one garment group's articles."""
    return Fi.drilldown(_style(spark, sf_dir), "garment_group_name", "bolt", ["article_id"]).select(
        "article_id", "avg_return_prob", "colour_group_name")


@query("garment_risk_histogram", STYLE_CTE + """,
s AS (SELECT avg_return_prob AS x FROM sb WHERE garment_group_name = 'bolt'),
m AS (SELECT min(x) AS lo, max(x) AS hi FROM s)
SELECT CASE WHEN hi = lo THEN 1 ELSE least(25, CAST(floor((x - lo) / (hi - lo) * 25.0) AS INTEGER) + 1) END AS bin,
       count(*) AS count FROM s, m GROUP BY 1""")
def q_garment_risk_histogram(spark, sf_dir):
    """F8 + K1: 25-bin risk histogram of one garment group."""
    from ..operators.prefix import with_scalars
    s = Fi.drilldown(_style(spark, sf_dir), "garment_group_name", "bolt").select("avg_return_prob")
    mm = s.agg(F.min("avg_return_prob").alias("_lo"), F.max("avg_return_prob").alias("_hi"))
    x = with_scalars(s, mm)
    return (x.select(C.equal_width_bin("avg_return_prob", F.col("_lo"), F.col("_hi"), 25).alias("bin"))
             .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))


def _pct_text_sql(x):
    return f"printf('%.1f%%', ({x}) * 100.0)"


@query("risk_export", STYLE_CTE + f"""
SELECT article_id AS "Article ID", product_type_name AS "Product type", colour_group_name AS "Color",
       garment_group_name AS "Garment", department_name AS "Departamento",
       {_pct_text_sql('avg_return_prob')} AS "Predicted", {_pct_text_sql('actual_return_rate')} AS "Actual",
       n_transactions AS "N transactions"
FROM (SELECT * FROM sb ORDER BY avg_return_prob DESC, article_id LIMIT 50)""")
def q_risk_export(spark, sf_dir):
    """T-e + C21: the top-50 risk table as exported (renamed columns,
    percentages as text with one decimal)."""
    s = K.top_k(_style(spark, sf_dir), 50, "avg_return_prob")
    return C.export_view(s, {"article_id": "Article ID", "product_type_name": "Product type",
                             "colour_group_name": "Color", "garment_group_name": "Garment",
                             "department_name": "Departamento"},
                         pct={"avg_return_prob": "Predicted", "actual_return_rate": "Actual"},
                         keep={"n_transactions": "N transactions"})


@query("segment_profile_export", STYLE_CTE + f""",
p AS (SELECT index_group_name, count(*) AS n_products, avg(avg_return_prob) AS return_rate,
             coalesce({_mode_sql('garment_group_name')}, 'N/A') AS top_garment,
             coalesce({_mode_sql('colour_group_name')}, 'N/A') AS top_color,
             coalesce({_mode_sql('department_name')}, 'N/A') AS top_dept
      FROM sb g WHERE index_group_name IS NOT NULL GROUP BY index_group_name)
SELECT 'Segment ' || index_group_name AS "Cluster", format('{{:,}}', n_products) AS "Productos",
       {_pct_text_sql('return_rate')} AS "Return rate", top_garment AS "Top garment", top_color AS "Top color",
       top_dept AS "Top departamento" FROM p""")
def q_segment_profile_export(spark, sf_dir):
    """A12 + C21: the profile table as exported (label, thousands marks,
    percent text); by index group, like ``segment_profile``."""
    p = A.cluster_profile(_style(spark, sf_dir), cluster="index_group_name")
    p = p.withColumns({"_label": F.concat(F.lit("Segment "), "index_group_name"), "_n": F.format_number("n_products", 0)})
    return C.export_view(p, {"_label": "Cluster", "_n": "Productos"}, pct={"return_rate": "Return rate"},
                         keep={"top_garment": "Top garment", "top_color": "Top color", "top_dept": "Top departamento"})


@query("cluster_risk_profile")
def q_cluster_risk_profile(spark, sf_dir):
    """J5 (all three tables) + A12: size, mean risk and modal attributes of
    every style cluster."""
    return A.cluster_profile(_clustered(spark, sf_dir))


@query("cluster_style_kpis")
def q_cluster_style_kpis(spark, sf_dir):
    """J5 + A14 with the number of style clusters."""
    return A.style_kpis(_clustered(spark, sf_dir))


@query("cluster_profile_export")
def q_cluster_profile_export(spark, sf_dir):
    """A12 + C21: the cluster profiles as exported."""
    p = A.cluster_profile(_clustered(spark, sf_dir))
    p = p.withColumns({"_label": F.concat(F.lit("Cluster "), F.col("cluster").cast("string")), "_n": F.format_number("n_products", 0)})
    return C.export_view(p, {"_label": "Cluster", "_n": "Productos"}, pct={"return_rate": "Return rate"},
                         keep={"top_garment": "Top garment", "top_color": "Top color", "top_dept": "Top departamento"})
