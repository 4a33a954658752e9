"""Registered queries: data profiles (A2-A4, A7, A13, T-a, W5, W6, K1, X1, X2)."""

from __future__ import annotations

from ..operators import aggregates as A
from ..operators import topk as K
from ..operators import windows as Wn
from ..sources.standin import Inputs, sql_with
from .catalog import R, query

SQL_MONTHLY = """SELECT CAST(date_trunc('month', t_dat) AS DATE) AS month, count(*) AS n_transactions
  FROM transactions WHERE t_dat IS NOT NULL GROUP BY 1"""


@query("monthly_volume", sql_with("transactions") + "\n" + SQL_MONTHLY)
def q_monthly_volume(spark, sf_dir):
    """A2: transactions per month."""
    return A.monthly_volume(Inputs(spark, sf_dir).transactions())


@query("extreme_months", sql_with("transactions") + f""",
m AS ({SQL_MONTHLY})
(SELECT month, n_transactions, 'busiest' AS kind FROM m ORDER BY n_transactions DESC, month LIMIT 5)
UNION ALL
(SELECT month, n_transactions, 'quietest' AS kind FROM m ORDER BY n_transactions ASC, month LIMIT 3)""")
def q_extreme_months(spark, sf_dir):
    """T-a: 5 busiest and 3 quietest months."""
    return K.extreme_months(A.monthly_volume(Inputs(spark, sf_dir).transactions()), 5, 3)


@query("sales_per_article", sql_with("transactions") + """
SELECT article_id, count(*) AS n_sales FROM transactions WHERE article_id IS NOT NULL GROUP BY 1""")
def q_sales_per_article(spark, sf_dir):
    """A3: sales per article."""
    return A.sales_per_article(Inputs(spark, sf_dir).transactions())


SQL_SALES = "SELECT article_id, count(*) AS n_sales FROM transactions WHERE article_id IS NOT NULL GROUP BY 1"


@query("pareto_curve", sql_with("transactions") + f""",
s AS ({SQL_SALES}),
c AS (SELECT article_id, n_sales,
             row_number() OVER (ORDER BY n_sales DESC, article_id) AS rank,
             sum(n_sales) OVER (ORDER BY n_sales DESC, article_id ROWS UNBOUNDED PRECEDING) AS cum,
             sum(n_sales) OVER () AS tot, count(*) OVER () AS n FROM s)
SELECT article_id, n_sales, rank, {R('100.0 * cum / tot')} AS cum_share_pct,
       {R('100.0 * rank / n')} AS article_pct FROM c""")
def q_pareto_curve(spark, sf_dir):
    """Pareto curve of article sales (global order, no single-task window)."""
    return Wn.pareto_curve(A.sales_per_article(Inputs(spark, sf_dir).transactions()))


@query("pareto_points", sql_with("transactions") + f""",
s AS ({SQL_SALES}),
c AS (SELECT n_sales, row_number() OVER (ORDER BY n_sales DESC, article_id) AS rank,
             sum(n_sales) OVER () AS tot, count(*) OVER () AS n FROM s),
p AS (SELECT unnest([10, 20, 50]) AS top_pct)
SELECT top_pct, CAST(floor(max(n) * top_pct / 100) AS BIGINT) AS n_top,
       {R('100.0 * sum(CASE WHEN rank <= floor(n * top_pct / 100) THEN n_sales ELSE 0 END) / max(tot)')} AS share_pct
FROM c, p GROUP BY top_pct""")
def q_pareto_points(spark, sf_dir):
    """Share of sales from the top 10 / 20 / 50 % of articles."""
    return Wn.pareto_points(A.sales_per_article(Inputs(spark, sf_dir).transactions()))


@query("price_profile", sql_with("transactions") + f"""
SELECT count(price) AS count, {R('avg(price)')} AS mean, {R('stddev_samp(price)')} AS std,
       {R('min(price)')} AS min, {R('quantile_cont(price, 0.01)')} AS p01,
       {R('quantile_cont(price, 0.5)')} AS p50, {R('quantile_cont(price, 0.95)')} AS p95,
       {R('quantile_cont(price, 0.99)')} AS p99, {R('max(price)')} AS max
FROM transactions""")
def q_price_profile(spark, sf_dir):
    """A4: price count, mean, std, min, p1/p50/p95/p99 (exact), max."""
    return A.describe(Inputs(spark, sf_dir).transactions(), "price")


@query("price_histogram", sql_with("transactions") + """,
q AS (SELECT quantile_cont(price, 0.99) AS hi FROM transactions)
SELECT CASE WHEN price = (SELECT hi FROM q) THEN 100
            ELSE CAST(floor(price / ((SELECT hi FROM q) / 100.0)) AS INTEGER) + 1 END AS bin, count(*) AS count
FROM transactions WHERE price IS NOT NULL GROUP BY 1""")
def q_price_histogram(spark, sf_dir):
    """K1: price in bins of which 100 cover [0, p99]; every row is binned."""
    return K.histogram_to_quantile(Inputs(spark, sf_dir).transactions(), "price", 100, 0.99)


@query("n_unique_articles", sql_with("transactions") + """
SELECT count(DISTINCT article_id) AS n_unique_article_id FROM transactions""")
def q_n_unique(spark, sf_dir):
    """Distinct articles sold."""
    return A.n_unique(Inputs(spark, sf_dir).transactions(), "article_id")


@query("value_counts_garment", sql_with("articles") + """
SELECT garment_group_name, count(*) AS count FROM articles WHERE garment_group_name IS NOT NULL GROUP BY 1""")
def q_value_counts(spark, sf_dir):
    """Value counts of a category."""
    return A.value_counts(Inputs(spark, sf_dir).articles(), "garment_group_name")


def _u_sql(salt):
    from ..functions.random import sql_uniform
    return sql_uniform(["tx_key"], salt)


@query("sample_n", sql_with("transactions") + f"""
SELECT tx_key, article_id FROM transactions ORDER BY {_u_sql('sample:42')}, tx_key LIMIT 5000""")
def q_sample_n(spark, sf_dir):
    """Exact-n reproducible sample (5,000 rows, seeded md5 order)."""
    tx = Inputs(spark, sf_dir).transactions().select("tx_key", "article_id")
    return K.sample_n(tx, 5000, ["tx_key"], 42)


@query("sample_stratified", sql_with("transactions") + f""",
t AS (SELECT tx_key, CAST(date_trunc('week', t_dat) AS DATE) AS week, {_u_sql('strat:42')} AS u FROM transactions),
r AS (SELECT tx_key, week, row_number() OVER (PARTITION BY week ORDER BY u, tx_key) AS rn,
             count(*) OVER (PARTITION BY week) AS n FROM t)
SELECT tx_key, week FROM r WHERE rn <= ceil(n * 0.1)""")
def q_sample_stratified(spark, sf_dir):
    """10 % week-stratified reproducible sample."""
    from ..functions import columns as C
    tx = Inputs(spark, sf_dir).transactions().select("tx_key", C.week_start("t_dat").alias("week"))
    return K.sample_stratified(tx, "week", 0.1, ["tx_key"], 42)


@query("sample_n_large", sql_with("transactions") + f"""
SELECT tx_key FROM transactions ORDER BY {_u_sql('sample:7')}, tx_key LIMIT 30000""")
def q_sample_n_large(spark, sf_dir):
    """X1 with a large n: half of the small table."""
    tx = Inputs(spark, sf_dir).transactions().select("tx_key")
    return K.sample_n(tx, 30000, ["tx_key"], 7)


@query("top_articles_by_sales", sql_with("transactions") + f"""
{SQL_SALES} ORDER BY n_sales DESC, article_id LIMIT 20""")
def q_top_articles(spark, sf_dir):
    """K0 / top-k: 20 best-selling articles (key tie-break)."""
    return K.top_k(A.sales_per_article(Inputs(spark, sf_dir).transactions()), 20, "n_sales")

