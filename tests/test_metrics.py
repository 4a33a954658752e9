"""Evaluation metrics: edge cases and brute-force agreement."""
import random

import pytest

from mercato.operators import evaluation as E
from mercato.functions import columns as C


def _df(spark, rows):
    return spark.createDataFrame(rows, "y double, p double")


def test_wape_zero_denominator_is_null(spark):
    r = _df(spark, [(0.0, 1.0), (0.0, 2.0)]).agg(E.wape("y", "p").alias("w")).first()
    assert r.w is None


def test_auc_all_ties_is_half(spark):
    r = E.roc_auc(_df(spark, [(1.0, 0.3), (0.0, 0.3), (1.0, 0.3), (0.0, 0.3)]), "y", "p").first()
    assert r.roc_auc == pytest.approx(0.5)


def test_ap_one_class_is_null(spark):
    r = E.average_precision(_df(spark, [(0.0, 0.3), (0.0, 0.6)]), "y", "p").first()
    assert r.average_precision is None


def _brute_auc(rows):
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    s = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def _brute_ap(rows):
    thr = sorted({p for _, p in rows}, reverse=True)
    P_ = sum(y for y, _ in rows)
    ap, prev_r = 0.0, 0.0
    for t in thr:
        tp = sum(1 for y, p in rows if p >= t and y == 1)
        fp = sum(1 for y, p in rows if p >= t and y == 0)
        r = tp / P_
        ap += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
    return ap


def test_auc_and_ap_match_brute_force(spark):
    rnd = random.Random(3)
    rows = [(float(rnd.random() < 0.4), round(rnd.random(), 2)) for _ in range(400)]
    df = _df(spark, rows)
    assert E.roc_auc(df, "y", "p").first().roc_auc == pytest.approx(_brute_auc(rows))
    assert E.average_precision(df, "y", "p").first().average_precision == pytest.approx(_brute_ap(rows))


def test_calibration_bins_right_closed(spark):
    df = _df(spark, [(1.0, 0.0), (0.0, 0.1), (1.0, 0.10001), (1.0, 1.0)])
    got = {r.bin: r.n for r in E.calibration_curve(df, "y", "p", 10).collect()}
    assert got == {1: 2, 2: 1, 10: 1}


def test_classification_report_counts(spark):
    df = _df(spark, [(1.0, 0.9), (1.0, 0.2), (0.0, 0.7), (0.0, 0.1), (0.0, 0.5)])
    rep = {r.label: r for r in E.classification_report(df, "y", "p", 0.5).collect()}
    assert rep["1"].precision == pytest.approx(0.5) and rep["1"].recall == pytest.approx(0.5)
    assert rep["0"].support == 3 and rep["accuracy"].f1 == pytest.approx(3 / 5)


def test_risk_tier_thresholds(spark):
    df = spark.createDataFrame([(0.1499,), (0.15,), (0.2999,), (0.30,)], "x double")
    got = [r.t for r in df.select(C.risk_tier("x").alias("t")).collect()]
    assert got == ["low", "mid", "mid", "high"]


def test_right_closed_bins_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.1000001,), (1.0,)], "x double")
    got = [r.b for r in df.select(C.right_closed_bin("x", 0.1, 10).alias("b")).collect()]
    assert got == [1, 1, 2, 10]


def test_classifier_summary_matches_separate_metrics(spark):
    rnd = random.Random(5)
    rows = [(float(rnd.random() < 0.3), round(rnd.random(), 3)) for _ in range(500)]
    df = _df(spark, rows)
    s = E.classifier_summary(df, "y", "p").first()
    assert s.roc_auc == pytest.approx(_brute_auc(rows))
    assert s.average_precision == pytest.approx(_brute_ap(rows))
    assert s.brier_score == pytest.approx(sum((p - y) ** 2 for y, p in rows) / len(rows))
    assert s.positive_rate == pytest.approx(sum(y for y, _ in rows) / len(rows)) and s.n == len(rows)


def _brute_roc(rows):
    thr = sorted({p for _, p in rows}, reverse=True)
    P_, N_ = sum(y for y, _ in rows), sum(1 - y for y, _ in rows)
    fps = [sum(1 for y, p in rows if p >= t and y == 0) for t in thr]
    tps = [sum(1 for y, p in rows if p >= t and y == 1) for t in thr]
    keep = [0] + [i for i in range(1, len(thr) - 1)
                  if (fps[i + 1] - 2 * fps[i] + fps[i - 1]) or (tps[i + 1] - 2 * tps[i] + tps[i - 1])] + [len(thr) - 1]
    return [(None, 0.0, 0.0)] + [(thr[i], fps[i] / N_, tps[i] / P_) for i in keep]


def _brute_pr(rows):
    thr = sorted({p for _, p in rows}, reverse=True)
    P_ = sum(y for y, _ in rows)
    out = []
    for t in thr:
        tp = sum(1 for y, p in rows if p >= t and y == 1)
        fp = sum(1 for y, p in rows if p >= t and y == 0)
        out.append((t, tp / (tp + fp), tp / P_))
        if tp == P_:
            break
    return out + [(None, 1.0, 0.0)]


def test_curve_points_match_brute_force(spark):
    rnd = random.Random(11)
    rows = [(float(rnd.random() < 0.35), round(rnd.random(), 1)) for _ in range(300)]
    rows += [(0.0, 0.95), (0.0, 0.96), (0.0, 0.97)]  # a straight segment to drop
    df = _df(spark, rows)
    key = lambda r: (-1 if r[0] is None else r[0])
    got = sorted([tuple(r) for r in E.roc_points(df, "y", "p").collect()], key=key)
    want = sorted(_brute_roc(rows), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1]) and a[2] == pytest.approx(b[2])
    got = sorted([tuple(r) for r in E.pr_points(df, "y", "p").collect()], key=key)
    want = sorted(_brute_pr(rows), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1]) and a[2] == pytest.approx(b[2])
