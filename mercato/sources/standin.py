"""Stand-in retail tables over the driver's TPC-H-like parquet files.

transactions = lineitem (+ orders only when the customer is needed),
articles = part, customers = customer. The mapping is fixed in FIXTURES.md
§3. Each view is a projection over a parquet scan, so Catalyst prunes the
columns a job does not use and pushes its filters into the scan.

``SQL_VIEWS`` holds the same views as DuckDB text for the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..functions.columns import normalize_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _first_word(c):
    return F.split(F.col(c), " ", -1)[0]


def _second_word(c):
    return F.element_at(F.split(F.col(c), " ", -1), 2)


def transactions(spark: SparkSession, sf_dir: str, with_customer: bool = False, customers: DataFrame | None = None) -> DataFrame:
    """One row per sale: t_dat, article_id, price, returned, tx_key (+ customer_id).

    The orders join is only planned when the customer is asked for, so the
    demand jobs scan lineitem alone. It moves the raw columns; keys become
    text behind it. The columns of ``customers`` are joined to the orders,
    of which there are fewer than sales.
    """
    rows, more = table(spark, sf_dir, "lineitem"), []
    if with_customer:
        orders = table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("l_orderkey"),
            F.col("o_custkey").cast("string").alias("customer_id"))
        if customers is not None:
            orders = orders.join(customers, "customer_id", "left")
        more = [c for c in orders.columns if c != "l_orderkey"]
        rows = rows.join(orders, "l_orderkey", "inner")
    return rows.select(
        F.col("l_shipdate").cast("date").alias("t_dat"),
        normalize_key("l_partkey").alias("article_id"),
        (F.col("l_extendedprice") / F.lit(P.STANDIN_PRICE_DIVISOR)).alias("price"),
        (F.col("l_returnflag") == F.lit("R")).cast("int").alias("returned"),
        F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
                    ).alias("tx_key"), *more)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    index_group = F.concat(F.lit("S"), F.floor((F.col("p_size") - 1) / 10).cast("string"))
    return p.select(
        normalize_key("p_partkey").alias("article_id"),
        F.col("p_name").alias("prod_name"),
        F.col("p_brand").alias("product_type_name"),
        F.col("p_type").alias("product_group_name"),
        _second_word("p_name").alias("graphical_appearance_name"),
        _first_word("p_name").alias("colour_group_name"),
        _first_word("p_name").alias("perceived_colour_master_name"),
        F.concat(F.col("p_type"), F.lit("/"), F.col("p_brand")).alias("department_name"),
        index_group.alias("index_group_name"),
        F.concat(index_group, F.lit("/"), F.col("p_type")).alias("section_name"),
        _second_word("p_name").alias("garment_group_name"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    seg = F.col("c_mktsegment")
    return c.select(
        k.cast("string").alias("customer_id"),
        F.when(k % 10 == 0, F.lit(None).cast("double"))
         .otherwise((F.lit(18) + k % 60).cast("double")).alias("age"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(seg).alias("club_member_status"),
        F.when(seg == "BUILDING", F.lit("Regularly"))
         .when(seg == "MACHINERY", F.lit("Monthly"))
         .when(seg == "FURNITURE", F.lit(None).cast("string"))
         .otherwise(F.lit("NONE")).alias("fashion_news_frequency"),
    )


class Inputs:
    """The three stand-in tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def transactions(self, with_customer: bool = False) -> DataFrame:
        return transactions(self.spark, self.sf_dir, with_customer)

    def customer_transactions(self) -> DataFrame:
        """The transactions with the columns of their customer."""
        return transactions(self.spark, self.sf_dir, True, self.customers())

    def articles(self) -> DataFrame:
        return articles(self.spark, self.sf_dir)

    def customers(self) -> DataFrame:
        return customers(self.spark, self.sf_dir)


# ---------------------------------------------------------------------------
# DuckDB text of the same views (SQL oracle only)
# ---------------------------------------------------------------------------
_KEY = ("CASE WHEN length(CAST({c} AS VARCHAR)) < 10 THEN lpad(CAST({c} AS VARCHAR), 10, '0') "
        "ELSE CAST({c} AS VARCHAR) END")

SQL_TRANSACTIONS = f"""
  SELECT CAST(l_shipdate AS DATE) AS t_dat,
         {_KEY.format(c='l_partkey')} AS article_id,
         l_extendedprice / {P.STANDIN_PRICE_DIVISOR!r} AS price,
         CAST(l_returnflag = 'R' AS INTEGER) AS returned,
         concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                   CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS tx_key
  FROM lineitem"""

SQL_TRANSACTIONS_CUST = f"""
  SELECT CAST(l_shipdate AS DATE) AS t_dat,
         {_KEY.format(c='l_partkey')} AS article_id,
         l_extendedprice / {P.STANDIN_PRICE_DIVISOR!r} AS price,
         CAST(l_returnflag = 'R' AS INTEGER) AS returned,
         concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                   CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS tx_key,
         CAST(o_custkey AS VARCHAR) AS customer_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

SQL_ARTICLES = f"""
  SELECT {_KEY.format(c='p_partkey')} AS article_id,
         p_name AS prod_name,
         p_brand AS product_type_name,
         p_type AS product_group_name,
         split_part(p_name, ' ', 2) AS graphical_appearance_name,
         split_part(p_name, ' ', 1) AS colour_group_name,
         split_part(p_name, ' ', 1) AS perceived_colour_master_name,
         p_type || '/' || p_brand AS department_name,
         'S' || CAST(CAST(floor((p_size - 1) / 10) AS BIGINT) AS VARCHAR) AS index_group_name,
         'S' || CAST(CAST(floor((p_size - 1) / 10) AS BIGINT) AS VARCHAR) || '/' || p_type AS section_name,
         split_part(p_name, ' ', 2) AS garment_group_name
  FROM part"""

SQL_CUSTOMERS = """
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
         CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(18 + c_custkey % 60 AS DOUBLE) END AS age,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS club_member_status,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'Regularly'
              WHEN c_mktsegment = 'MACHINERY' THEN 'Monthly'
              WHEN c_mktsegment = 'FURNITURE' THEN NULL
              ELSE 'NONE' END AS fashion_news_frequency
  FROM customer"""


def sql_with(*views: str) -> str:
    """``WITH`` prefix defining the named stand-in views for an oracle query."""
    defs = {"transactions": SQL_TRANSACTIONS, "transactions_c": SQL_TRANSACTIONS_CUST,
            "articles": SQL_ARTICLES, "customers": SQL_CUSTOMERS}
    return "WITH " + ",\n".join(f"{v} AS ({defs[v]})" for v in views)
