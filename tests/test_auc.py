"""ROC-AUC of boosting rounds from counts by ranges of scores."""
import numpy as np
import pytest

from mercato.ml import boosting as B


@pytest.mark.parametrize("range_rows", [1 << 20, 150])
def test_auc_over_ranges_is_that_of_all_pairs(spark, monkeypatch, range_rows):
    """Ties within and between blocks, a constant round, negative zero; no
    row of a round is exploded, so the plan has no generator."""
    monkeypatch.setattr(B, "RANGE_ROWS", range_rows)
    rng = np.random.default_rng(5)
    label = rng.integers(0, 2, 1000).astype(float)
    margins = np.stack([rng.normal(size=1000) + label, rng.integers(-3, 4, 1000) * 0.5, np.zeros(1000),
                        np.where(rng.random(1000) < 0.5, 0.0, -0.0)], axis=1)
    df = spark.createDataFrame([(float(y), m.tolist()) for y, m in zip(label, margins)], "label double, margins array<double>").repartition(7)
    got = B.auc_by_round(df, 4)
    yes, no = margins[label == 1], margins[label == 0]
    want = [((yes[:, k, None] > no[None, :, k]).mean() + (yes[:, k, None] == no[None, :, k]).mean() / 2) for k in range(4)]
    assert [-g for g in got] == pytest.approx(want, abs=1e-12)
    assert B.auc_by_round(df.where("label = 1"), 2) == [float("inf")] * 2
    assert B.auc_by_round(df.limit(0), 1) == [float("inf")]
