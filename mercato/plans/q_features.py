"""Registered queries: feature store (sources, A1, J1/J2, F1-F6, W1-W3, C2-C6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..operators import aggregates as A
from ..operators import filters as Fi
from ..operators import joins as J
from ..operators import windows as Wn
from ..sources import io
from ..sources.standin import Inputs, sql_with
from . import feature_store as FS
from .catalog import R, query

ATTRS = ", ".join(f"a.{c}" for c in P.ARTICLE_ATTRS)

SQL_WEEKLY = """
  SELECT article_id, CAST(date_trunc('week', t_dat) AS DATE) AS week,
         count(*) AS units_sold, avg(CAST(price AS DOUBLE)) AS avg_price
  FROM transactions WHERE article_id IS NOT NULL AND t_dat IS NOT NULL
  GROUP BY 1, 2"""

TE = P.STANDIN_TRAIN_END
VE = P.STANDIN_VAL_END

SQL_LAGS = f"""
  SELECT *,
    CAST(lag(units_sold, 1) OVER w AS DOUBLE) AS lag_1,
    CAST(lag(units_sold, 2) OVER w AS DOUBLE) AS lag_2,
    CAST(lag(units_sold, 4) OVER w AS DOUBLE) AS lag_4,
    avg(CAST(units_sold AS DOUBLE)) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS rolling_mean_4,
    avg(CAST(units_sold AS DOUBLE)) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS rolling_mean_8
  FROM weekly WINDOW w AS (PARTITION BY article_id ORDER BY week)"""


@query("weekly_sales", sql_with("transactions", "articles") + f""",
weekly AS ({SQL_WEEKLY})
SELECT w.article_id, w.week, w.units_sold, {R('w.avg_price')} AS avg_price, {ATTRS}
FROM weekly w LEFT JOIN articles a ON w.article_id = a.article_id""")
def q_weekly_sales(spark, sf_dir):
    """A1 + J1: the 13-column article x week table (flagship)."""
    inp = Inputs(spark, sf_dir)
    return FS.weekly_sales_enriched(inp.transactions(), inp.articles())


@query("scan_transactions", sql_with("transactions") + f"""
SELECT t_dat, article_id, {R('price')} AS price, returned, tx_key FROM transactions""")
def q_scan_transactions(spark, sf_dir):
    """Typed transaction scan."""
    return Inputs(spark, sf_dir).transactions()


@query("scan_articles", sql_with("articles") + "\nSELECT * FROM articles")
def q_scan_articles(spark, sf_dir):
    """Article dimension."""
    return Inputs(spark, sf_dir).articles()


@query("scan_customers", sql_with("customers") + "\nSELECT * FROM customers")
def q_scan_customers(spark, sf_dir):
    """S3: customer dimension."""
    return Inputs(spark, sf_dir).customers()


@query("preview_transactions", sql_with("transactions") + f"""
SELECT t_dat, article_id, {R('price')} AS price, returned, tx_key FROM transactions
ORDER BY tx_key LIMIT 5""")
def q_preview(spark, sf_dir):
    """First 5 rows in key order."""
    return io.preview(Inputs(spark, sf_dir).transactions(), "tx_key", 5)


@query("table_profile", sql_with("transactions", "articles", "customers") + """
SELECT 'transactions' AS table_name, count(*) AS n_rows, CAST(5 AS BIGINT) AS n_cols FROM transactions
UNION ALL SELECT 'articles', count(*), CAST(11 AS BIGINT) FROM articles
UNION ALL SELECT 'customers', count(*), CAST(4 AS BIGINT) FROM customers""")
def q_table_profile(spark, sf_dir):
    """Rows and columns per loaded table."""
    inp = Inputs(spark, sf_dir)
    return io.table_profile({"transactions": inp.transactions(), "articles": inp.articles(),
                             "customers": inp.customers()})


@query("with_week_month", sql_with("transactions") + """
SELECT tx_key, CAST(date_trunc('week', t_dat) AS DATE) AS week,
       CAST(date_trunc('month', t_dat) AS DATE) AS month FROM transactions""")
def q_with_week_month(spark, sf_dir):
    """Week and month buckets."""
    from ..functions import columns as C
    tx = Inputs(spark, sf_dir).transactions()
    return tx.select("tx_key", C.week_start("t_dat").alias("week"),
                     C.month_start("t_dat").alias("month"))


@query("min_history", sql_with("transactions") + f""",
weekly AS ({SQL_WEEKLY})
SELECT article_id, week, units_sold, {R('avg_price')} AS avg_price FROM weekly
WHERE article_id IN (SELECT article_id FROM weekly GROUP BY 1 HAVING count(*) >= 8)""")
def q_min_history(spark, sf_dir):
    """articles with at least 8 weekly rows (all their rows)."""
    return Fi.min_history(A.weekly_sales(Inputs(spark, sf_dir).transactions()), 8)


@query("history_report", sql_with("transactions") + f""",
weekly AS ({SQL_WEEKLY}),
per AS (SELECT article_id, count(*) AS n FROM weekly GROUP BY 1)
SELECT count(*) AS n_articles, count(*) FILTER (WHERE n >= 8) AS n_kept,
       {R('100.0 * count(*) FILTER (WHERE n >= 8) / count(*)')} AS kept_pct FROM per""")
def q_history_report(spark, sf_dir):
    """A5: articles total / kept / kept %."""
    return Fi.history_report(A.weekly_sales(Inputs(spark, sf_dir).transactions()), 8)


@query("cold_start", sql_with("transactions") + f""",
weekly AS ({SQL_WEEKLY})
SELECT article_id, week, units_sold, {R('avg_price')} AS avg_price FROM weekly
WHERE article_id IN (SELECT article_id FROM weekly WHERE week <= DATE '{TE}'
                     GROUP BY 1 HAVING count(*) >= {P.STANDIN_COLD_START_WEEKS})""")
def q_cold_start(spark, sf_dir):
    """articles with >= 20 weeks on or before train end (stand-in floor)."""
    return Fi.cold_start_filter(A.weekly_sales(Inputs(spark, sf_dir).transactions()), TE,
                                P.STANDIN_COLD_START_WEEKS)


@query("lag_features", sql_with("transactions") + f""",
weekly AS ({SQL_WEEKLY}), f AS ({SQL_LAGS})
SELECT article_id, week, units_sold, {R('avg_price')} AS avg_price, lag_1, lag_2, lag_4,
       {R('rolling_mean_4')} AS rolling_mean_4, {R('rolling_mean_8')} AS rolling_mean_8 FROM f""")
def q_lag_features(spark, sf_dir):
    """W1 + W2: row lags 1/2/4 and rolling means of the previous 4/8 rows."""
    return FS.lag_features(A.weekly_sales(Inputs(spark, sf_dir).transactions()))


@query("weeks_in_catalog", sql_with("transactions") + f""",
weekly AS ({SQL_WEEKLY})
SELECT article_id, week, CAST(floor(datediff('day', min(week) OVER (PARTITION BY article_id), week) / 7) AS INTEGER)
       AS weeks_in_catalog FROM weekly""")
def q_weeks_in_catalog(spark, sf_dir):
    """Whole weeks since the article's first week."""
    w = A.weekly_sales(Inputs(spark, sf_dir).transactions())
    return Wn.with_weeks_in_catalog(w).select("article_id", "week", "weeks_in_catalog")


SQL_FEATURES = f"""
  SELECT f.*, CAST(month(week) AS INTEGER) AS month, CAST(weekofyear(week) AS INTEGER) AS week_of_year,
         CAST(quarter(week) AS INTEGER) AS quarter,
         sin(2 * pi() * month(week) / 12.0) AS month_sin, cos(2 * pi() * month(week) / 12.0) AS month_cos,
         CAST(floor(datediff('day', min(week) OVER (PARTITION BY f.article_id), week) / 7) AS INTEGER) AS weeks_in_catalog,
         ln(1 + units_sold) AS log_units, ln(1 + lag_1) AS log_lag_1, ln(1 + lag_2) AS log_lag_2,
         ln(1 + lag_4) AS log_lag_4, ln(1 + rolling_mean_4) AS log_rolling_mean_4,
         ln(1 + rolling_mean_8) AS log_rolling_mean_8,
         {", ".join("a." + c for c in P.CATEGORY_COLS)}
  FROM ({SQL_LAGS.replace('FROM weekly', 'FROM (SELECT * FROM weekly WHERE article_id IN (SELECT article_id FROM weekly WHERE week <= DATE ' + repr(TE) + ' GROUP BY 1 HAVING count(*) >= ' + str(P.STANDIN_COLD_START_WEEKS) + '))')}) f
  LEFT JOIN articles a ON f.article_id = a.article_id"""

FEATURE_COLS_OUT = ["article_id", "week", "units_sold", "avg_price", "lag_1", "lag_2", "lag_4",
                    "rolling_mean_4", "rolling_mean_8", "weeks_in_catalog", "month", "week_of_year",
                    "quarter", "month_sin", "month_cos", *P.CATEGORY_COLS, "log_units",
                    "log_lag_1", "log_lag_2", "log_lag_4", "log_rolling_mean_4", "log_rolling_mean_8"]


def _r_or_plain(c):
    return R(c) if c in {"avg_price", "rolling_mean_4", "rolling_mean_8", "month_sin", "month_cos",
                         "log_units", "log_lag_1", "log_lag_2", "log_lag_4", "log_rolling_mean_4",
                         "log_rolling_mean_8"} else c


@query("build_features", sql_with("transactions", "articles") + f""",
weekly AS ({SQL_WEEKLY}), feats AS ({SQL_FEATURES})
SELECT {", ".join(_r_or_plain(c) + " AS " + c for c in FEATURE_COLS_OUT)}
FROM feats WHERE lag_4 IS NOT NULL AND rolling_mean_8 IS NOT NULL""")
def q_build_features(spark, sf_dir):
    """F3 -> W1/W2/W3 -> C4/C5 -> J2 -> C6 -> F1: the 18-feature modelling set."""
    inp = Inputs(spark, sf_dir)
    w = A.weekly_sales(inp.transactions())
    out = FS.build_features(w, inp.articles(), TE, P.STANDIN_COLD_START_WEEKS, extended=True)
    return out.select(*FEATURE_COLS_OUT)


SPLIT_SQL = f"""CASE WHEN week <= DATE '{TE}' THEN 'train'
                     WHEN week <= DATE '{VE}' THEN 'val' ELSE 'test' END"""


@query("temporal_split", sql_with("transactions") + f""",
weekly AS ({SQL_WEEKLY})
SELECT {SPLIT_SQL} AS split, count(*) AS n_rows, min(week) AS min_week, max(week) AS max_week,
       {R('avg(units_sold)')} AS mean_units
FROM weekly WHERE week IS NOT NULL GROUP BY 1""")
def q_temporal_split(spark, sf_dir):
    """F5 + A19: right-closed chronological split, profiled per split."""
    w = A.weekly_sales(Inputs(spark, sf_dir).transactions())
    s = Fi.with_split(w, "week", TE, VE)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.min("week").alias("min_week"),
                                  F.max("week").alias("max_week"),
                                  F.avg("units_sold").alias("mean_units"))


@query("temporal_split_bounded", sql_with("transactions") + f"""
SELECT tx_key, t_dat, CASE WHEN t_dat <= DATE '{TE}' THEN 'train'
                          WHEN t_dat <= DATE '{VE}' THEN 'val' ELSE 'test' END AS split
FROM transactions WHERE t_dat <= DATE '2001-06-30'""")
def q_temporal_split_bounded(spark, sf_dir):
    """three-way split with a bounded test end (rows past it fall out)."""
    tx = Inputs(spark, sf_dir).transactions()
    return Fi.with_split(tx, "t_dat", TE, VE, "2001-06-30").select("tx_key", "t_dat", "split")


@query("holdout_split", sql_with("transactions") + f""",
weekly AS ({SQL_WEEKLY}),
cut AS (SELECT min(week) AS c FROM (SELECT DISTINCT week FROM weekly ORDER BY week DESC LIMIT 8))
SELECT CASE WHEN week >= (SELECT c FROM cut) THEN 'test' ELSE 'train' END AS split,
       count(*) AS n_rows, min(week) AS min_week, max(week) AS max_week
FROM weekly GROUP BY 1""")
def q_holdout_split(spark, sf_dir):
    """F6 + A19: last 8 distinct weeks as holdout."""
    w = A.weekly_sales(Inputs(spark, sf_dir).transactions())
    return A.split_profile(Fi.with_holdout(w, 8))


@query("distinct_weeks", sql_with("transactions") + """
SELECT DISTINCT CAST(date_trunc('week', t_dat) AS DATE) AS week FROM transactions WHERE t_dat IS NOT NULL""")
def q_distinct_weeks(spark, sf_dir):
    """Distinct weeks (sorted on output)."""
    from ..operators import topk as K
    w = A.weekly_sales(Inputs(spark, sf_dir).transactions())
    return K.distinct_values(w, "week")


@query("ensure_attributes", sql_with("transactions", "articles") + f""",
weekly AS ({SQL_WEEKLY})
SELECT w.article_id, w.week, w.units_sold, {", ".join("a." + c for c in P.CATEGORY_COLS)}
FROM weekly w LEFT JOIN articles a ON w.article_id = a.article_id""")
def q_ensure_attributes(spark, sf_dir):
    """Add only the missing category columns."""
    inp = Inputs(spark, sf_dir)
    w = A.weekly_sales(inp.transactions()).drop("avg_price")
    return J.enrich_articles(w, inp.articles(), P.CATEGORY_COLS)


@query("join_coverage", sql_with("transactions", "articles") + f""",
weekly AS ({SQL_WEEKLY})
SELECT {R('avg(CASE WHEN a.product_group_name IS NOT NULL THEN 1.0 ELSE 0.0 END)')} AS coverage,
       count(*) AS n_rows
FROM weekly w LEFT JOIN articles a ON w.article_id = a.article_id""")
def q_join_coverage(spark, sf_dir):
    """Share of weekly rows with article metadata."""
    inp = Inputs(spark, sf_dir)
    w = J.enrich_articles(A.weekly_sales(inp.transactions()), inp.articles(), ["product_group_name"])
    return J.join_coverage(w, "product_group_name")


@query("drop_incomplete", sql_with("transactions") + f""",
weekly AS ({SQL_WEEKLY}), f AS ({SQL_LAGS})
SELECT count(*) AS n_rows FROM f WHERE lag_4 IS NOT NULL AND rolling_mean_8 IS NOT NULL""")
def q_drop_incomplete(spark, sf_dir):
    """rows with lag_4 and rolling_mean_8 present."""
    f = FS.lag_features(A.weekly_sales(Inputs(spark, sf_dir).transactions()))
    return Fi.drop_incomplete(f, ["lag_4", "rolling_mean_8"]).agg(F.count(F.lit(1)).alias("n_rows"))


@query("weekly_sales_stream", sql_with("transactions") + f"""
SELECT article_id, week, units_sold, {R('avg_price')} AS avg_price FROM ({SQL_WEEKLY})""")
def q_weekly_sales_stream(spark, sf_dir):
    """A1 as a Structured Streaming job (availableNow over the lineitem
    files, update mode, batch-tagged output, latest version per group)."""
    from ..session import checkpoint_dir
    from ..streaming.weekly import latest_weekly_sales, run_weekly_sales
    import uuid
    base = f"{checkpoint_dir(spark).rstrip('/')}/streams/weekly_{uuid.uuid4().hex[:8]}"
    run_weekly_sales(spark, sf_dir, f"{base}/out", f"{base}/checkpoint")
    return latest_weekly_sales(spark, f"{base}/out")


def _scratch(spark, name):
    import uuid
    from ..session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/stage/{name}_{uuid.uuid4().hex[:8]}"


@query("stage_roundtrip", sql_with("transactions", "articles") + f""",
weekly AS ({SQL_WEEKLY})
SELECT w.article_id, w.week, w.units_sold, {R('w.avg_price')} AS avg_price, {ATTRS}
FROM weekly w LEFT JOIN articles a ON w.article_id = a.article_id""")
def q_stage_roundtrip(spark, sf_dir):
    """S6 + S4: write the weekly table as a Parquet stage table (partitioned
    by product group) under the shared folder and read it back."""
    inp = Inputs(spark, sf_dir)
    d = _scratch(spark, "weekly")
    io.write_stage(FS.weekly_sales_enriched(inp.transactions(), inp.articles()), d, "weekly_sales",
                   partition_by="product_group_name")
    back = io.read_stage(spark, d, "weekly_sales")
    return back.select("article_id", "week", "units_sold", "avg_price", *P.ARTICLE_ATTRS)


@query("csv_roundtrip", sql_with("transactions_c") + f"""
SELECT t_dat, customer_id, article_id, {R('CAST(CAST(price AS FLOAT) AS DOUBLE)')} AS price
FROM transactions_c""")
def q_csv_roundtrip(spark, sf_dir):
    """S7 + S1: write transactions in the raw CSV layout (header), read them
    back with the fixed raw schema (dates parsed, ids as text)."""
    tx = Inputs(spark, sf_dir).transactions(with_customer=True)
    d = _scratch(spark, "tx_csv")
    raw = tx.select(F.col("t_dat").cast("string").alias("t_dat"), "customer_id", "article_id", "price",
                    F.lit(None).cast("byte").alias("sales_channel_id"))
    io.write_csv(raw, d)
    back = io.read_transactions(spark, d, fmt="csv")
    return back.select("t_dat", "customer_id", "article_id", F.col("price").cast("double").alias("price"))


@query("raw_articles_roundtrip", sql_with("articles") + """
SELECT article_id, prod_name, product_group_name, garment_group_name,
       'Part "' || prod_name || '",' || chr(10) || 'second line' AS detail_desc FROM articles""")
def q_raw_articles_roundtrip(spark, sf_dir):
    """S2 + S7: articles written in the raw 25-column CSV layout, with quotes
    and a line break in the description, and read back in the fixed schema."""
    art = Inputs(spark, sf_dir).articles()
    desc = F.concat(F.lit('Part "'), F.col("prod_name"), F.lit('",\nsecond line'))
    have = {**{c: F.col(c) for c in art.columns}, "detail_desc": desc}
    raw = art.select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in io.ARTICLES_SCHEMA])
    d = _scratch(spark, "articles_csv")
    io.write_csv(raw, d)
    return io.read_articles(spark, d, fmt="csv").select("article_id", "prod_name", "product_group_name",
                                                        "garment_group_name", "detail_desc")


@query("raw_customers_roundtrip", sql_with("customers") + """
SELECT customer_id, club_member_status, fashion_news_frequency, CAST(age AS DOUBLE) AS age FROM customers""")
def q_raw_customers_roundtrip(spark, sf_dir):
    """S3 + S7: customers written in the raw 7-column CSV layout and read back."""
    cust = Inputs(spark, sf_dir).customers()
    raw = cust.select(*[(F.col(f.name) if f.name in cust.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                        for f in io.CUSTOMERS_SCHEMA])
    d = _scratch(spark, "customers_csv")
    io.write_csv(raw, d)
    back = io.read_customers(spark, d, fmt="csv")
    return back.select("customer_id", "club_member_status", "fashion_news_frequency", F.col("age").cast("double").alias("age"))


@query("article_features", sql_with("transactions", "articles") + f"""
SELECT a.article_id, {ATTRS} FROM articles a
WHERE a.article_id IN (SELECT article_id FROM transactions WHERE article_id IS NOT NULL AND t_dat IS NOT NULL)""")
def q_article_features(spark, sf_dir):
    """J6 + S6 + S4: the article_features stage table, attributes of the
    articles that the weekly table has, written and read back."""
    inp = Inputs(spark, sf_dir)
    d = _scratch(spark, "features")
    weekly = A.weekly_sales(inp.transactions())
    io.write_stage(J.semi_by_keys(inp.articles(), weekly).select("article_id", *P.ARTICLE_ATTRS), d, "article_features")
    return io.read_stage(spark, d, "article_features")


@query("metrics_json_roundtrip")
def q_metrics_json_roundtrip(spark, sf_dir):
    """The nested executive summary written as JSON and read back, as
    section / item / metric / value rows."""
    from . import planning as PP
    from .q_planning import _nested_summary
    d = _scratch(spark, "summary")
    nested = _nested_summary(spark, sf_dir)
    io.write_metrics(nested, d)
    return PP.summary_rows(spark.read.schema(nested.schema).json(d))
