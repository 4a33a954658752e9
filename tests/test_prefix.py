"""Distributed running totals and exact percentiles against brute force,
including a hot key holding a third of the rows."""
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st

from mercato.operators.prefix import exact_percentiles, running_totals


def test_running_totals_global_order(spark):
    rows = [(i, float((i * 7919) % 101)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v double")
    got = {r.k: r.cum_v for r in running_totals(df, [("v", True), ("k", True)], ["v"], buckets=7).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    acc = 0.0
    for k, v in order:
        acc += v
        assert got[k] == pytest.approx(acc)


def test_running_totals_with_hot_group(spark):
    rows = [("hot" if i % 3 == 0 else f"g{i % 5}", i, 1) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, k long, one long")
    out = running_totals(df, ["k"], ["one"], by=["g"], buckets=6).collect()
    for g in {r.g for r in out}:
        ks = sorted(r.k for r in out if r.g == g)
        got = {r.k: r.cum_one for r in out if r.g == g}
        assert [got[k] for k in ks] == list(range(1, len(ks) + 1))
        assert all(r.total_one == len(ks) for r in out if r.g == g)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(min_value=-50, max_value=50), min_size=1, max_size=60))
def test_exact_percentiles_match_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {r.prob: r.value for r in exact_percentiles(df, "x", probs, buckets=3).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(np.array(values, dtype=float), p)))


def test_grouped_median_with_hot_group(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 == 0 else f"g{i % 4}", float(rng.integers(0, 40))) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.value for r in exact_percentiles(df, "x", [0.5], by=["g"], buckets=5).collect()}
    for g in got:
        assert got[g] == pytest.approx(float(np.median([x for gg, x in rows if gg == g])))


def test_a_missed_bracket_is_widened(spark, monkeypatch):
    """Brackets that a bad sketch put beside the wanted ranks: they are made
    wider until they hold them; no group is lost."""
    from mercato.operators import prefix
    rng = random.Random(7)
    rows = [(g, rng.gauss(0, 1)) for g in "abc" for _ in range(900)]
    df = spark.createDataFrame(rows, "g string, x double")
    real, asked = prefix._brackets, []

    def beside(vals, probs, by, accuracy):
        asked.append(accuracy)
        out = real(vals, probs, by, accuracy)
        return (out[0], out[1], [c + 5 for c in out[2]], out[3]) if len(asked) == 1 else out

    monkeypatch.setattr(prefix, "_brackets", beside)
    got = {(r.g, r.prob): r.value for r in prefix.exact_percentiles(df, "x", [0.1, 0.5], ["g"], accuracy=200).collect()}
    assert asked == [200, 50]
    for g in "abc":
        own = pd.Series([x for h, x in rows if h == g])
        for p in (0.1, 0.5):
            assert got[g, p] == pytest.approx(own.quantile(p))


@pytest.mark.parametrize("few", [0, 10**9])
def test_percentiles_by_window_and_by_ranges(spark, monkeypatch, few):
    from mercato.operators import prefix
    monkeypatch.setattr(prefix, "FEW_CELLS", few)
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), float(rng.randrange(300))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {(r.g, r.prob): r.value for r in prefix.exact_percentiles(df, "x", [0.01, 0.5, 0.99], ["g"], accuracy=100).collect()}
    for g in ("a", "b", None):
        own = pd.Series([x for h, x in rows if h == g])
        for p in (0.01, 0.5, 0.99):
            assert got[g, p] == pytest.approx(own.quantile(p))
