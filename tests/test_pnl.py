"""The reference's three properties and hand-derived values."""
import pytest

from mercato.operators import planning as PL

CASES = [  # demand, p, qty, price, sold, markdown, destroyed, lost, rev_full, rev_md, cogs, ret, destr, lost_m, margin
    (100, 0.2, 120, 29.99, 100, 17.0, 3.0, 0.0, 2999.0, 305.898, 1691.436, 360.0, 42.2859, 0.0, 1211.1761),
    (100, 0.2, 100, 29.99, 100, 0.0, 0.0, 0.0, 2999.0, 0.0, 1409.53, 360.0, 0.0, 0.0, 1229.47),
    (100, 0.2, 200, 29.99, 100, 85.0, 15.0, 0.0, 2999.0, 1529.49, 2819.06, 360.0, 211.4295, 0.0, 1138.0005),
    (100, 0.05, 100, 29.99, 100, 0.0, 0.0, 0.0, 2999.0, 0.0, 1409.53, 90.0, 0.0, 0.0, 1499.47),
    (100, 0.4, 100, 29.99, 100, 0.0, 0.0, 0.0, 2999.0, 0.0, 1409.53, 720.0, 0.0, 0.0, 869.47),
    (100, 0.2, 80, 29.99, 80, 0.0, 0.0, 20.0, 2399.2, 0.0, 1127.624, 288.0, 0.0, 317.894, 665.682),
]


def _pnl(spark, rows):
    df = spark.createDataFrame([tuple(float(v) for v in r[:4]) for r in rows],
                               "demand double, return_prob double, production_qty_in double, unit_price double")
    return PL.with_pnl(df, "demand", "production_qty_in", "return_prob", "unit_price").collect()


def test_breakdown_has_named_keys(spark):
    r = _pnl(spark, CASES[:1])[0].asDict()
    for k in ["production_qty", "sold_full_price", "sold_at_markdown", "destroyed", "lost_demand",
              "revenue_full", "revenue_markdown", "cost_of_goods", "return_cost", "destruction_cost",
              "lost_margin_cost", "expected_margin"]:
        assert k in r


def test_overproduction_lowers_margin(spark):
    bal, over = _pnl(spark, [CASES[1], CASES[2]])
    assert bal.expected_margin > over.expected_margin


def test_higher_returns_lower_margin(spark):
    low, high = _pnl(spark, [CASES[3], CASES[4]])
    assert low.expected_margin > high.expected_margin


def test_hand_derived_values(spark):
    names = ["sold_full_price", "sold_at_markdown", "destroyed", "lost_demand", "revenue_full",
             "revenue_markdown", "cost_of_goods", "return_cost", "destruction_cost", "lost_margin_cost",
             "expected_margin"]
    for case, row in zip(CASES, _pnl(spark, CASES)):
        for name, want in zip(names, case[4:]):
            assert row[name] == pytest.approx(want, abs=1e-4), name


def test_portfolio_totals(spark):
    df = spark.createDataFrame([tuple(float(v) for v in r[:4]) for r in CASES],
                               "demand double, return_prob double, q double, unit_price double")
    t = PL.portfolio_pnl(PL.with_pnl(df, "demand", "q", "return_prob", "unit_price")).first()
    assert t.total_production == pytest.approx(sum(c[2] for c in CASES))
    assert t.total_margin == pytest.approx(sum(c[14] for c in CASES), abs=1e-3)
    assert t.total_unsold == pytest.approx(sum(c[5] + c[6] for c in CASES))
    assert t.returned_units == pytest.approx(t.total_return_cost / 18.0)
