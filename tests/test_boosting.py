"""Boosting with patience: rounds, stop, the model that is kept."""
import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from mercato.ml import boosting as B


def frame(spark, n, seed, classes=False):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x, z = rng.random(), rng.random()
        y = 3 * x * x - z + rng.gauss(0, 0.3)
        rows.append((x, z, float(y > 0.8) if classes else y))
    df = spark.createDataFrame(rows, "x double, z double, label double")
    return VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(df).select("features", "label")


def test_stop_rule():
    assert B.stop([3.0, 2.0, 2.0, 2.5], 3) == (1, False)
    assert B.stop([3.0, 2.0, 2.0, 2.5, 2.1], 3) == (1, True)
    assert B.stop([1.0], 1) == (0, False)


def test_patience_stops_at_the_round_of_a_full_run(spark):
    train, val = frame(spark, 600, 1), frame(spark, 300, 2)
    how = dict(step=0.5, depth=3, leaf_rows=5, chunk=5)
    full = B.boost(train, val, rounds=30, patience=1000, **how)
    made = B.boost(train, val, rounds=30, patience=6, **how)
    assert len(full.history) == 30 and len(made.history) < 30
    assert made.history == pytest.approx(full.history[:len(made.history)])
    # the stop that patience gives on the whole history
    upto = next(n for n in range(1, 31) if B.stop(full.history[:n], 6)[1])
    assert made.best == B.stop(full.history[:upto], 6)[0]
    assert made.model.getNumTrees == made.best + 1
    # the kept model has the error that its round was judged by
    error = made.model.transform(val).agg(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0]
    assert error == pytest.approx(made.history[made.best])


def test_auc_of_every_round_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(float(rng.random() < 0.4), [round(rng.random(), 1) for _ in range(4)]) for _ in range(400)]
    got = B.auc_by_round(spark.createDataFrame(rows, "label double, margins array<double>"), 4)
    for k in range(4):
        pos, neg = [m[k] for y, m in rows if y], [m[k] for y, m in rows if not y]
        want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
        assert -got[k] == pytest.approx(want)


def test_classifier_stops_on_auc_and_is_read_back(spark, tmp_path):
    train, val = frame(spark, 500, 4, True), frame(spark, 300, 5, True)
    made = B.boost(train, val, classifier=True, rounds=12, patience=4, step=0.3, depth=2, leaf_rows=10, chunk=6)
    assert made.history[made.best] == min(made.history) and -made.history[made.best] > 0.8
    PipelineModel(stages=[made.model]).write().overwrite().save(f"{tmp_path}/m")
    loaded = PipelineModel.load(f"{tmp_path}/m").stages[0]
    assert loaded.getNumTrees == made.best + 1
    a = made.model.transform(val).select("probability").collect()
    assert a == loaded.transform(val).select("probability").collect()
    scored = loaded.transform(val).select("label", F.array("rawPrediction").alias("r"))
    from pyspark.ml.functions import vector_to_array
    margins = loaded.transform(val).select("label", F.array(vector_to_array("rawPrediction")[1]).alias("margins"))
    assert B.auc_by_round(margins, 1)[0] == pytest.approx(made.history[made.best])
    assert scored.count() == 300 and sum(loaded.featureImportances.toArray()) == pytest.approx(1)


def test_no_validation_rows_and_weights(spark):
    train = frame(spark, 200, 6, True).withColumn("weight", F.when(F.col("label") == 1, 2.0).otherwise(0.5))
    made = B.boost(train, train.drop("weight").limit(0), classifier=True, rounds=3, depth=2, leaf_rows=5, chunk=2)
    assert made.model.getNumTrees == 3 and made.history == []


def test_a_tree_is_mllibs_tree(spark):
    """One round at step 1: the splits, values and importances of MLlib's own
    tree on the same bag, with numeric and nominal features."""
    import numpy as np
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.regression import DecisionTreeRegressor

    from mercato.ml import trees as T
    rng = random.Random(7)
    rows = []
    for _ in range(500):
        c, x = rng.randrange(40), rng.choice([0.0, 1.0, 2.0, 3.0])
        rows.append((str(c), x, (c * 7 % 11) + x * x + rng.gauss(0, 0.1)))
    df = spark.createDataFrame(rows, "c string, x double, label double").coalesce(1)
    df = Pipeline(stages=[StringIndexer(inputCol="c", outputCol="i", handleInvalid="keep"),
                          VectorAssembler(inputCols=["x", "i"], outputCol="features", handleInvalid="keep")]).fit(df).transform(df)
    train = df.select("features", "label")
    made = B.boost(train, train.limit(0), rounds=2, step=0.5, depth=3, leaf_rows=5)
    kept = [r for r, k in zip(train.collect(), T.in_bag(np.arange(500), 42)) if k]  # half of twice the residual
    mean = sum(r["label"] for r in train.collect()) / 500
    bag = spark.createDataFrame([(r["features"], r["label"] - mean) for r in kept], train.schema)
    want = DecisionTreeRegressor(maxDepth=3, maxBins=64, minInstancesPerNode=5).fit(bag)
    got = made.model.transform(train).select(F.col("prediction") - mean).collect()
    assert [r[0] for r in got] == pytest.approx([r["prediction"] for r in want.transform(train).collect()])
    assert made.model.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray())


def test_bins_come_once_and_do_not_grow_with_the_categories(spark):
    """Numeric features keep their bins beside a feature of many categories,
    and the table isn't read again for them in each round."""
    from pyspark.ml.feature import StringIndexer
    df = spark.range(4000).select(F.col("id").cast("string").alias("c"), F.rand(1).alias("x"), F.rand(2).alias("label"))
    df = StringIndexer(inputCol="c", outputCol="i").fit(df).transform(df)
    bins = B.bins_of(VectorAssembler(inputCols=["x", "i"], outputCol="features").transform(df), 256)
    assert bins.sizes[1] == 4000 and 200 < bins.sizes[0] <= 256 and bins.thresholds[1] is None


def test_blocks_hold_what_a_level_must_read(spark):
    """Bins of up to 256 take a byte, weights of 1 and consecutive row numbers
    are not stored; the sums by bin are those of whole blocks."""
    import numpy as np
    import pyarrow as pa

    from mercato.ml import trees as T
    rng = np.random.default_rng(1)
    n, bins = 300, T.Bins([np.array([0.3, 0.6]), None], [3, 40])
    x, label = np.stack([rng.random(n), rng.integers(0, 40, n).astype(float)], axis=1), rng.random(n)
    margin = rng.random(n)

    def sums(weight, row, weighted):
        batch = pa.RecordBatch.from_arrays([pa.array(x.tolist()), pa.array(label), pa.array(weight), pa.array(row)],
                                           ["x", "label", "weight", "row"])
        stored = next(T.packed(bins)(iter([batch]))).to_pylist()[0]
        tree = T.Tree((0.0, 0.0, 0.0))
        return stored, list(T.histograms([(*T.unpacked(bins)(stored), margin)], tree, [0], bins.sizes, T.squared_gradient, 5, weighted))

    ones, rows = np.ones(n), np.arange(n) + 7
    lean, got = sums(ones, rows, True)
    assert [len(lean[c]) for c in ("bins", "label", "weight", "row")] == [2 * n, 8 * n, 0, 8]
    keep = T.in_bag(rows, 5)
    want = np.bincount(x[keep, 1].astype(int), 2 * (label - margin)[keep], 40)
    assert np.allclose(got[1][1][2], want) and (got[1][1][0] == got[1][1][1]).all() and got[1][1][0].sum() == keep.sum()
    back, other = sums(ones * 2, rows[::-1].copy(), True)  # numbers and weights that must be stored
    assert [len(back[c]) for c in ("weight", "row")] == [8 * n, 8 * n]
    keep = T.in_bag(rows[::-1], 5)
    assert np.allclose(other[1][1][2], 2 * np.bincount(x[keep, 1].astype(int), 2 * (label - margin)[keep], 40))


def test_rounds_in_one_task_sums_on_the_driver_and_shuffled_sums_agree(spark, monkeypatch):
    """A small table runs a chunk of rounds in one job; pieces send their sums
    to the driver, or by feature where those would be many. All are one model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer
    rng = random.Random(11)
    rows = [(str(i % 9), rng.random(), float(i % 9 * 7 % 5) + rng.gauss(0, 0.2)) for i in range(900)]
    df = spark.createDataFrame(rows, "c string, x double, label double").repartition(6).cache()
    df = Pipeline(stages=[StringIndexer(inputCol="c", outputCol="i", handleInvalid="keep"),
                          VectorAssembler(inputCols=["x", "i"], outputCol="features", handleInvalid="keep")]).fit(df).transform(df)
    train = df.select("features", "label").cache()
    assert train.count() == 900
    sc, jobs, made = spark.sparkContext, [], []
    for name, here, sent in (("here", 1 << 19, 1 << 26), ("driver", 0, 1 << 26), ("shuffled", 0, 0)):
        monkeypatch.setattr(B, "HERE_ROWS", here)
        monkeypatch.setattr(B, "SENT_BYTES", sent)
        monkeypatch.setattr(B, "LEAST_PIECE", 300)
        sc.setJobGroup(f"boost-{name}", name)
        made.append(B.boost(train, train, rounds=10, step=0.5, depth=4, leaf_rows=5))
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"boost-{name}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert made[1].history == pytest.approx(made[0].history) and made[2].history == pytest.approx(made[0].history)
    assert jobs[1] - jobs[0] >= 9 * 4 - 1  # nine trees of four levels, in one job here
    for other in made[1:]:
        assert other.model.toDebugString.count("If") == made[0].model.toDebugString.count("If")
        assert other.model.featureImportances.toArray() == pytest.approx(made[0].model.featureImportances.toArray())


def test_of_two_siblings_only_the_smaller_is_summed():
    import numpy as np

    from mercato.ml import trees as T
    rng = np.random.default_rng(2)
    bins, n = T.Bins([np.linspace(0, 1, 15)[1:-1], None], [14, 6]), 4000
    x = np.stack([rng.random(n), rng.integers(0, 6, n)], axis=1)
    block = (bins.of(x), x[:, 0] ** 2 + (x[:, 1] % 3), np.zeros(0), np.array([0]), np.zeros(n))
    asked = []

    def sums_of(tree, nodes):
        asked.append(sum(tree.totals[i][0] for i in nodes))
        return T.joined([s for _, s in T.histograms([block], tree, nodes, bins.sizes, T.squared_gradient, None, False)], len(nodes))
    tree, _, _ = T.grown(T.Looks(sums_of, bins, 10), 10, depth=4)
    assert max(asked[1:]) <= n / 2 and len(tree.totals) > 20
    at = tree.walk(block[0])
    for node in set(at.tolist()):  # what is left of the parent is what its rows sum to
        assert tree.totals[node][0] == (at == node).sum()
        assert tree.totals[node][2] == pytest.approx(2 * block[1][at == node].sum())


@pytest.mark.parametrize("leaves", [2, 7, 31])
def test_leaves_are_split_in_the_order_of_their_gains(leaves):
    """The tree of so many leaves is the one that splits a leaf at a time, the
    one of the largest gain, though its looks are fewer than its splits."""
    import numpy as np

    from mercato.ml import trees as T
    rng = np.random.default_rng(leaves)
    n, l2, least = 3000, 0.5, 8
    bins = T.Bins([np.linspace(0, 1, 20)[1:-1], np.linspace(0, 1, 9)[1:-1]], [19, 8])
    x = rng.random((n, 2))
    cells, y = bins.of(x).astype(int), np.sin(9 * x[:, 0]) * (x[:, 1] > 0.4) + rng.normal(size=n) * 0.1

    def best(rows):
        s, w, out = y[rows].sum(), len(rows), (0.0, None, None)
        for f in (0, 1):
            for cut in range(bins.sizes[f] - 1):
                left = cells[f][rows] <= cut
                k = left.sum()
                if min(k, w - k) < least:
                    continue
                a, b = y[rows][left].sum(), y[rows][~left].sum()
                gain = a * a / (k + l2) + b * b / (w - k + l2) - s * s / (w + l2)
                if gain > out[0] + 1e-9:
                    out = (gain, rows[left], rows[~left])
        return out

    want = [(best(np.arange(n)), np.arange(n))]
    while len(want) < leaves:
        i = max(range(len(want)), key=lambda j: want[j][0][0])
        (gain, a, b), _ = want.pop(i)
        assert gain > 0
        want += [(best(a), a), (best(b), b)]
    looks = []
    held = T.Held([(bins.of(x), y, np.zeros(0), np.array([0]), np.zeros(n))], bins, T.residual)
    plain = T.Looks.__call__
    try:
        T.Looks.__call__ = lambda self, tree, nodes: looks.append(1) or plain(self, tree, nodes)
        tree = held.round(None, 0.3, least, leaves=leaves, l2=l2)
    finally:
        T.Looks.__call__ = plain
    at = tree.walk(bins.of(x))
    assert {tuple(np.flatnonzero(at == node)) for node in set(at.tolist())} == {tuple(rows) for _, rows in want}
    for _, rows in want:
        assert held.blocks[0][4][rows] == pytest.approx(0.3 * y[rows].sum() / (len(rows) + l2))
    assert len(looks) <= leaves


def test_points_of_a_grid_in_tasks_of_their_own_or_in_pieces(spark, monkeypatch):
    train, val = frame(spark, 900, 21).repartition(5).cache(), frame(spark, 300, 22)
    assert train.count() == 900
    points = [dict(rounds=12, step=0.3, depth=3, leaf_rows=1, l2=1.0), dict(rounds=12, step=0.1, leaves=6, leaf_rows=20)]
    here = B.boosters(train, points)
    monkeypatch.setattr(B, "POINT_ROWS", 0)
    monkeypatch.setattr(B, "LEAST_PIECE", 300)
    pieces = B.boosters(train, points)
    assert [len(f) for f in here.fits] == [len(f) for f in pieces.fits] == [12, 12]
    assert max(len(t.totals) for t in here.fits[1]) == 11  # six leaves
    assert here.wapes(val) == pytest.approx(pieces.wapes(val))
    for i, wape in enumerate(here.wapes(val)):  # the ensemble that is kept predicts what was judged
        scored = here.model(spark, i).transform(val).withColumn("p", F.greatest(F.col("prediction"), F.lit(0.0)))
        got = scored.agg(F.sum(F.abs(F.col("label") - F.col("p"))) / F.sum(F.abs("label"))).first()[0]
        assert wape == pytest.approx(got)
    assert here.wapes(val)[0] < 0.5


def test_features_are_counted_in_bundles():
    """Rows are counted once for a bundle of features, not once for each, and
    a feature's sums are those of its own."""
    import numpy as np

    from mercato.ml import trees as T
    sizes, n = [4, 300, 7, 12, 5, 2], 2000
    assert [sorted(b) for b in T.bundles(tuple(sizes), 1200)] == [[0, 1], [2, 3, 4, 5]]
    assert [f for b in T.bundles(tuple(sizes), 1) for f in b] == [1, 3, 2, 4, 0, 5]  # one by one
    rng = np.random.default_rng(4)
    bins = np.stack([rng.integers(0, s, n) for s in sizes]).astype(np.uint16)
    slot, target, w = rng.integers(0, 3, n), rng.normal(size=n), rng.random(n)
    chosen = np.flatnonzero(rng.random(n) < 0.7)
    sums = T.Sums(sizes, 3, True)
    assert len(sums.bundles) < len(sizes)
    sums.add(bins, slot[chosen], chosen, target[chosen], w[chosen])
    sums.add(bins, slot, None, target, None)
    for f, got in enumerate(sums.by_feature()):
        cell = slot * sizes[f] + bins[f]
        for row, first, second in ((0, np.ones(n), np.ones(n)), (1, w, np.ones(n)), (2, target, target)):
            want = np.bincount(cell[chosen], first[chosen], 3 * sizes[f]) + np.bincount(cell, second, 3 * sizes[f])
            assert got[row] == pytest.approx(want)
