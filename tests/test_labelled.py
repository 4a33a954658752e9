"""Labelled transactions: joined once, whatever is read from them."""
from pyspark.sql import functions as F

from mercato.operators import joins as J
from mercato.operators import windows as Wn
from mercato.operators.prefix import group_percentile
from mercato.plans import q_returns
from mercato.plans import returns as RT
from mercato.sources.standin import Inputs

from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_labels_read_the_joined_rows(spark):
    """Medians, ages and labels read a stored table: neither the fact table
    nor the orders are joined again (return_labels, return_features)."""
    for name in ("q_return_labels", "q_return_features", "q_returns_split_profile", "q_return_rate_by_group"):
        plan = _plan(getattr(q_returns, name)(spark, SF_SMALL))
        assert "lineitem.parquet" not in plan and "orders.parquet" not in plan, name


def test_customers_joined_to_orders_or_to_transactions(spark):
    inp = Inputs(spark, SF_SMALL)
    once = inp.customer_transactions()
    after = J.enrich_customers(inp.transactions(with_customer=True), inp.customers())
    assert sorted(once.columns) == sorted(after.columns)
    assert once.count() == after.count() and once.exceptAll(after.select(once.columns)).isEmpty()


def test_medians_count_repeated_customers(spark):
    """The narrow medians are those of the joined rows, also where an id
    repeats among the customers."""
    inp = Inputs(spark, SF_SMALL)
    tx, articles, customers = inp.transactions(with_customer=True).cache(), inp.articles(), inp.customers()
    twice = customers.unionByName(customers.where(F.col("customer_id").cast("int") % 3 == 0))
    for c in (customers, twice):
        joined = RT.joined_transactions(tx, articles, c)
        want = {r[0]: r[1] for r in group_percentile(joined, "price", 0.5, ["product_group_name"], "m").collect()}
        got = {r[0]: r[1] for r in RT.price_medians(tx, articles, c).collect()}
        assert got == want
        whole = RT.labelled_transactions(tx, articles, c)
        assert whole.count() == joined.count()
        assert {r[0]: r[1] for r in whole.select("product_group_name", "price_median_group").distinct().collect()} == want
    tx.unpersist()
    assert Wn.group_medians(joined.limit(0), "product_group_name", "price", "m").count() == 0
