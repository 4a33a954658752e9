"""Sources and sinks.

Raw files are read with fixed schemas (no inference pass over the data);
stage tables are Parquet, so column pruning and filter pushdown reach the
scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import normalize_key

TRANSACTIONS_SCHEMA = T.StructType([
    T.StructField("t_dat", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("article_id", T.StringType()),
    T.StructField("price", T.FloatType()),
    T.StructField("sales_channel_id", T.ByteType()),
])

ARTICLES_SCHEMA = T.StructType([
    T.StructField("article_id", T.StringType()),
    T.StructField("product_code", T.IntegerType()),
    T.StructField("prod_name", T.StringType()),
    T.StructField("product_type_no", T.ShortType()),
    T.StructField("product_type_name", T.StringType()),
    T.StructField("product_group_name", T.StringType()),
    T.StructField("graphical_appearance_no", T.IntegerType()),
    T.StructField("graphical_appearance_name", T.StringType()),
    T.StructField("colour_group_code", T.ShortType()),
    T.StructField("colour_group_name", T.StringType()),
    T.StructField("perceived_colour_value_id", T.ByteType()),
    T.StructField("perceived_colour_value_name", T.StringType()),
    T.StructField("perceived_colour_master_id", T.ByteType()),
    T.StructField("perceived_colour_master_name", T.StringType()),
    T.StructField("department_no", T.ShortType()),
    T.StructField("department_name", T.StringType()),
    T.StructField("index_code", T.StringType()),
    T.StructField("index_name", T.StringType()),
    T.StructField("index_group_no", T.ByteType()),
    T.StructField("index_group_name", T.StringType()),
    T.StructField("section_no", T.ByteType()),
    T.StructField("section_name", T.StringType()),
    T.StructField("garment_group_no", T.ShortType()),
    T.StructField("garment_group_name", T.StringType()),
    T.StructField("detail_desc", T.StringType()),
])

CUSTOMERS_SCHEMA = T.StructType([
    T.StructField("customer_id", T.StringType()),
    T.StructField("FN", T.FloatType()),
    T.StructField("Active", T.FloatType()),
    T.StructField("club_member_status", T.StringType()),
    T.StructField("fashion_news_frequency", T.StringType()),
    T.StructField("age", T.FloatType()),
    T.StructField("postal_code", T.StringType()),
])


def _reader(spark: SparkSession, path: str, schema: T.StructType, fmt: str | None, quoted_lines: bool = False):
    """Raw rows in the declared schema. ``quoted_lines`` reads quoted text
    with line breaks and doubled quotes; such files cannot be split, so it is
    for the article and customer tables only. Other formats are cast to the
    schema; a missing column is an error."""
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if fmt == "csv":
        reader = spark.read.schema(schema).option("header", True)
        if quoted_lines:
            reader = reader.option("multiLine", True).option("escape", '"')
        return reader.csv(path)
    raw = spark.read.format(fmt).load(path)
    missing = [f.name for f in schema if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


# S1 --------------------------------------------------------------------------
def read_transactions(spark: SparkSession, path: str, nrows: int | None = None,
                      fmt: str | None = None) -> DataFrame:
    """Transactions with ``t_dat`` as a date and text ids; ``nrows`` keeps
    the first n rows of the file (a feature of the scan, as in the reference)."""
    df = _reader(spark, path, TRANSACTIONS_SCHEMA, fmt)
    if nrows is not None:
        df = df.limit(int(nrows))
    return (df.withColumn("t_dat", F.to_date(F.col("t_dat").cast("string")))
              .withColumn("article_id", normalize_key("article_id")))


# S2 / S3 -----------------------------------------------------------------------
def read_articles(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    return _reader(spark, path, ARTICLES_SCHEMA, fmt, quoted_lines=True).withColumn(
        "article_id", normalize_key("article_id"))


def read_customers(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    return _reader(spark, path, CUSTOMERS_SCHEMA, fmt, quoted_lines=True)


# S4 ------------------------------------------------------------------------------
def read_stage(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


# S5 ------------------------------------------------------------------------------
def preview(df: DataFrame, order_by, n: int = 5) -> DataFrame:
    """First ``n`` rows in a fixed key order (a top-k, not a driver collect)."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*keys).limit(n)


# S6 / S7 -------------------------------------------------------------------------
def write_stage(df: DataFrame, directory: str, name: str, partition_by=None) -> str:
    path = f"{directory.rstrip('/')}/{name}.parquet"
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with a header; quotes inside text are doubled."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


# S8 ------------------------------------------------------------------------------
def write_metrics(df: DataFrame, path: str) -> str:
    """Nested metrics / summary rows as JSON lines (struct and array columns
    are kept nested)."""
    df.write.mode("overwrite").json(path)
    return path


# S9 ------------------------------------------------------------------------------
def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: name, rows, columns. Each count is its own job
    on executors; only the tiny result comes back."""
    parts = []
    for name, df in tables.items():
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows"))
                     .select(F.lit(name).alias("table_name"), "n_rows",
                             F.lit(len(df.columns)).cast("long").alias("n_cols")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("table_name", "n_rows", "n_cols")
