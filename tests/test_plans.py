"""Plan checks: scans are pruned, and every single-partition exchange sits
on an aggregate (a global aggregate after map-side partial aggregation, or
the per-range totals table) — never on raw fact rows."""
import contextlib
import io
import re

import pytest

import __spark_entry__ as E

from conftest import SF_SMALL

HEADLINE = ["weekly_sales", "build_features", "pareto_curve", "price_profile", "baseline_report",
            "article_return_risk", "classifier_metrics", "scenario_pnl", "alpha_sweep", "risk_matrix",
            "top_risk_in_group", "sample_stratified", "risk_tiers", "best_sellers"]
AGG_NODES = {"HashAggregate", "ObjectHashAggregate", "SortAggregate"}


def _plan(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", HEADLINE)
def test_single_partition_exchanges_sit_on_aggregates(spark, name):
    txt = _plan(spark, name)
    tree, _, details = txt.partition("\n\n")
    single_ids = set(re.findall(r"\((\d+)\) Exchange\s*\nInput[^\n]*\nArguments: SinglePartition", txt))
    lines = [l for l in txt.splitlines() if re.search(r"[A-Za-z]+ \(\d+\)$", l.strip())]
    for i, l in enumerate(lines):
        m = re.search(r"Exchange \((\d+)\)$", l.strip())
        if m and m.group(1) in single_ids:
            child = re.search(r"([A-Za-z]+) \(\d+\)$", lines[i + 1].strip()).group(1)
            assert child in AGG_NODES, f"{name}: single-partition exchange over {child}"


def test_weekly_scan_is_pruned(spark):
    txt = _plan(spark, "weekly_sales")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", txt)
    lineitem = [s for s in schemas if "l_partkey" in s]
    assert lineitem and all(len(s.split(",")) == 3 for s in lineitem)
    assert "orders" not in txt
