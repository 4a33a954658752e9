"""Boosting with patience: rounds go on until the validation metric has not
improved for ``patience`` rounds, and the rounds up to the best one are the
model. No round is fitted twice.

The first tree is a single leaf, the mean label or the log-odds. A round is
one regression tree on the gradient of the margin so far, grown level by level
from histograms: a level is one Spark job in which every task sums its rows by
(node, bin) of each feature, the sums are shuffled and added by feature, and
the best split of a feature's nodes is found where its sums are. The driver
only sees the best splits. As in MLlib's trees, a split takes the largest fall
in variance, and the categories of a node are ordered by their mean.

Features are put into bins once for all rounds: numeric ones into up to
``max_bins`` bins at quantiles (256, the boosting libraries' usual number),
categories one each. (MLlib's tree bins anew in every fit and, as it needs one
number of bins for all features, draws the square of the largest number of
categories in rows, the whole table, each time.) Margins are carried along
with the rows and written every ``chunk`` rounds, so a round costs the same
whatever its number and the lineage does not grow. After each chunk all its
rounds are judged in one job on the validation rows: absolute error, or
ROC-AUC from counts of the scores by (round, range). The trees are written in
MLlib's model format and read as one ordinary MLlib ensemble, which can be
saved and scored like any other.

Bagging takes nine of ten rows by a hash of the row number, drawn anew every
five rounds, so a retried task sees the same rows.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship, stored
from .trees import (Bins, Looks, Tree, advanced, best_splits, error_sums, fits_here, grown, histograms, joined, logistic_gradient, offer,
                    packed, range_area, residual, rounds_here, rows_of, score_counts, score_marks, squared_gradient, stepped,
                    units_errors, unpacked)

# Fixed values of the study: rounds, patience, learning rate, rows of a leaf, renewal of the bag.
ROUNDS, PATIENCE, STEP, LEAF_ROWS, BAG_ROUNDS = 1000, 50, 0.05, 100, 5
CHUNK = 10
LEAST_PIECE = 1 << 17  # rows
HERE_ROWS = 1 << 19  # rows that one task runs whole rounds over
POINT_ROWS = 1 << 22  # rows that a task of its own fits each of several points of a grid to
SENT_BYTES = 64 << 20  # sums that the tasks of a level may send to the driver
RANGE_ROWS = 1 << 20  # rows of a round that one task orders, about
ONE = BatchedSerializer(CPickleSerializer(), 1)  # a block at a time; two RDDs of it are zipped as they are
MARKS = 65  # scores of a block that ranges are cut at
SKETCH = 10_000  # accuracy of the quantiles that bins end at


@dataclass
class Boosted:
    """The model, the metric of every round that was run and the best one."""

    model: object
    history: list[float] = field(default_factory=list)
    best: int = 0


def mae_by_round(val: DataFrame, rounds: int) -> list[float]:
    """Mean absolute error of each entry of ``margins``, of rows or of judged
    blocks."""
    if "n" in val.columns:
        ship(val.sparkSession)
        sums = val.select("n", "label", "margins").mapInArrow(error_sums(rounds), "n long, sums array<double>").collect()
        n = sum(r["n"] for r in sums)
        return [math.fsum(r["sums"][k] for r in sums) / n if n else float("inf") for k in range(rounds)]
    row = val.agg(*[F.avg(F.abs(F.col("label") - F.col("margins")[k])).alias(f"m{k}") for k in range(rounds)]).first()
    return [float(v) if v is not None else float("inf") for v in row]


def auc_by_round(val: DataFrame, rounds: int) -> list[float]:
    """Exact, tie-aware ROC-AUC of each entry of ``margins``, of rows or of
    judged blocks. A task counts its
    distinct scores by round and range of scores; a range is ordered where its
    counts come together, and the ranges' sums are added up in their order. A
    round with more than ``RANGE_ROWS`` rows has several ranges, cut at marks of
    its scores, so no round's scores are in one task."""
    ship(val.sparkSession)
    rows = val.select("n", "label", "margins") if "n" in val.columns else val.select("label", "margins").where(F.col("label").isNotNull())
    marks = rows.mapInArrow(score_marks(rounds, MARKS), "round int, n long, marks array<double>").collect()
    cuts = []
    for k in range(rounds):
        mine = [r for r in marks if r["round"] == k]
        ranges = -(-sum(r["n"] for r in mine) // RANGE_ROWS)
        known = np.sort(np.concatenate([r["marks"] for r in mine])) if ranges > 1 else np.zeros(0)
        cuts.append(np.unique(known[[len(known) * j // ranges for j in range(1, ranges)]]) if ranges > 1 else known)
    counts = rows.mapInArrow(score_counts(rounds, cuts), "round int, part int, score binary, pos binary, neg binary")
    sums = counts.groupBy("round", "part").applyInArrow(range_area, "round int, part int, pos long, neg long, area long").collect()
    out = []
    for k in range(rounds):
        pos = neg = area = 0
        for r in sorted((r for r in sums if r["round"] == k), key=lambda r: r["part"]):
            area += r["area"] + 2 * r["pos"] * neg
            pos, neg = pos + r["pos"], neg + r["neg"]
        out.append(-area / (2 * pos * neg) if pos and neg else float("inf"))
    return out


def stop(history: Sequence[float], patience: int) -> tuple[int, bool]:
    """The best round so far (the first of equal ones), and whether
    ``patience`` rounds have gone by since without a better one."""
    best = min(range(len(history)), key=lambda k: history[k])
    return best, len(history) - 1 - best >= patience


def bins_of(train: DataFrame, max_bins: int) -> Bins:
    """Nominal features by the metadata of the vector; thresholds half way
    between neighbouring quantiles of the others."""
    meta = train.schema["features"].metadata.get("ml_attr", {})
    arity = {a["idx"]: len(a["vals"]) if "vals" in a else a["num_vals"]
             for a in meta.get("attrs", {}).get("nominal", []) if "vals" in a or "num_vals" in a}
    first = None if "num_attrs" in meta else train.select("features").first()
    n = meta["num_attrs"] if "num_attrs" in meta else len(first[0]) if first else 0
    numeric = [f for f in range(n) if f not in arity]
    x = train.select(vector_to_array("features").alias("x"))
    ends = [k / (max_bins - 1) for k in range(max_bins)]
    got = x.agg(*[F.percentile_approx(F.when(~F.isnan(F.col("x")[f]), F.col("x")[f]), ends, SKETCH).alias(f"q{f}")
                  for f in numeric]).first() if numeric else {}
    cuts = {}
    for f in numeric:
        q = np.unique(np.array(got[f"q{f}"] or [], float))
        cuts[f] = (q[1:] + q[:-1]) / 2
    return Bins([cuts.get(f) for f in range(n)], [arity[f] if f in arity else len(cuts[f]) + 1 for f in range(n)])


def in_blocks(df: DataFrame, bins: Bins) -> DataFrame:
    """The rows of ``df`` (features, label, weight, row) as blocks of arrays,
    stored once."""
    rows = df.select(vector_to_array("features").alias("x"), "label", "weight", "row")
    return stored(rows.mapInArrow(packed(bins), "n long, bins binary, label binary, weight binary, row binary"), "blocks")


def with_margins(blocks: RDD, margins: RDD) -> RDD:
    return blocks.zip(margins).map(lambda bm: (*bm[0], bm[1]))


def grow(state: RDD, bins: Bins, gradient: Callable, seed: int | None, depth: int | None, leaf_rows: int, weighted: bool,
         leaves: int | None = None, l2: float = 0.0) -> Tree:
    """One tree on the gradient, a job per level (or look, with ``leaves``). The sums of the tasks are
    added on the driver while all of them are under ``SENT_BYTES``; more are
    shuffled by feature and the driver sees the best splits alone."""
    sizes, nominal, pieces = bins.sizes, [t is None for t in bins.thresholds], state.getNumPartitions()
    most = (3 if weighted else 2) * 8 * sum(sizes) * (leaves or max(1, 1 << depth >> 2))  # half of the last level's nodes are summed

    def added(tree, nodes):
        total = None
        for part in state.mapPartitions(lambda blocks: _one(histograms(blocks, tree, nodes, sizes, gradient, seed, weighted),
                                                            len(nodes))).collect():
            total = part if total is None else np.add(total, part, out=total)
        return total

    def shuffled(tree, nodes):
        found = (state.mapPartitions(lambda blocks: histograms(blocks, tree, nodes, sizes, gradient, seed, weighted))
                 .reduceByKey(np.add, max(1, min(len(sizes), pieces)))
                 .map(lambda kv: _offers(kv[0], kv[1].reshape(len(kv[1]), len(nodes), -1), nominal[kv[0]], leaf_rows, l2)).collect())
        found.sort(key=lambda made: made[0][2])
        return [max((made[k] for made in found), key=lambda o: o[1] or 0.0) for k in range(len(nodes))] if found else []

    look = Looks(added, bins, leaf_rows, l2) if most * pieces <= SENT_BYTES else shuffled
    return grown(look, leaf_rows, depth, leaves, l2)[0]


def _one(sums: Iterator[tuple[int, np.ndarray]], n_nodes: int) -> Iterator[np.ndarray]:
    by_feature = [s for _, s in sums]
    if by_feature:
        yield joined(by_feature, n_nodes)


def _offers(f: int, sums: np.ndarray, nominal: bool, leaf_rows: int, l2: float) -> list[tuple]:
    found = best_splits(f, sums, nominal, leaf_rows, l2)
    return [offer(f, k, sums.shape[2], found) for k in range(sums.shape[1])]


# the model ----------------------------------------------------------------------
def ensemble(spark: SparkSession, trees: list[Tree], weights: list[float], bins: Bins, classifier: bool):
    """One MLlib model of the trees: written in MLlib's format, then loaded.
    Importances read a node's gain and weight; the spread of a node is not
    known, so its impurity is left at 0."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/ensemble-{uuid.uuid4().hex}"
    model = GBTClassificationModel if classifier else GBTRegressionModel
    kind = "classification.GBTClassificationModel" if classifier else "regression.GBTRegressionModel"

    def about(kind: str, **more) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
                           "uid": f"boosted_{uuid.uuid4().hex[:12]}", "paramMap": {}, "defaultParamMap": {"impurity": "variance"}, **more})

    def nodes(i: int, t: Tree) -> Iterator[tuple]:
        for node, (split, (n, w, s), value) in enumerate(zip(t.split, t.totals, t.values().tolist())):
            how = (-1, [], -1)
            if split:
                f, goes, _ = split
                cuts = bins.thresholds[f]
                how = ((f, [float(c) for c in np.flatnonzero(goes)], bins.sizes[f]) if cuts is None
                       else (f, [float(cuts[int(goes.sum()) - 1])], -1))
            yield i, (node, value, 0.0, [float(w), float(s), float(s * value)], int(n), float(split[2]) if split else -1.0,
                      t.left[node] if split else -1, t.right[node] if split else -1, how)

    spark.createDataFrame([(about(kind, numFeatures=len(bins.sizes), numTrees=len(trees)),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame([(i, about("regression.DecisionTreeRegressionModel"), float(w)) for i, w in enumerate(weights)],
                          "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([r for i, t in enumerate(trees) for r in nodes(i, t)], """treeID int, nodeData struct<id: int, prediction: double,
        impurity: double, impurityStats: array<double>, rawCount: long, gain: double, leftChild: int, rightChild: int,
        split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>""").write.parquet(f"{path}/data")
    return model.load(path)


def start(train: DataFrame, classifier: bool) -> tuple[float, int]:
    """The margin to start from, the mean label or half the log-odds, and the
    number of rows."""
    w = F.col("weight") if "weight" in train.columns else F.lit(1.0)
    total, weight, rows = train.agg(F.sum(F.col("label") * w), F.sum(w), F.count(F.lit(1))).first()
    if not weight:
        return 0.0, rows
    mean = float(total) / float(weight)
    if not classifier:
        return mean, rows
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    return 0.5 * math.log(mean / (1 - mean)), rows


def boost(train: DataFrame, val: DataFrame, classifier: bool = False, rounds: int = ROUNDS, patience: int = PATIENCE,
          step: float = STEP, depth: int = 6, leaf_rows: int = LEAF_ROWS, max_bins: int = 256, seed: int = 42,
          chunk: int = CHUNK, judge: Callable[[DataFrame, int], list[float]] | None = None) -> Boosted:
    """Fit on ``train`` (features, label, optional weight), judged on ``val``
    (features, label). Without validation rows all ``rounds`` are kept."""
    spark = train.sparkSession
    ship(spark)
    checkpoint_dir(spark)
    by_rows, judge = judge is not None, judge or (auc_by_round if classifier else mae_by_round)
    gradient = logistic_gradient if classifier else squared_gradient
    weighted = "weight" in train.columns
    label, one = F.col("label").cast("double").alias("label"), F.lit(1.0).alias("weight")
    margin0, n_rows = start(train, classifier)
    bins = bins_of(train, max_bins)
    read = unpacked(bins)
    # a small table in one piece, which runs the rounds of a chunk in one job; a large one in a piece per core
    here = n_rows <= HERE_ROWS
    pieces = 1 if here else min(-(-n_rows // LEAST_PIECE), spark.sparkContext.defaultParallelism)
    numbered = train.select("features", label, F.col("weight").cast("double").alias("weight") if weighted else one)
    blocks = in_blocks(numbered.withColumn("row", F.monotonically_increasing_id()), bins).rdd.map(read)
    blocks = blocks._reserialize(ONE).coalesce(pieces).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    judged = in_blocks(val.select("features", label, one, F.lit(0).cast("long").alias("row")), bins)
    judging = not judged.isEmpty()
    judged = judged.select("n", "bins", "label", F.lit(None).cast("binary").alias("margin"))

    def kept(margins: RDD) -> RDD:
        old.append(margins._reserialize(ONE).persist(StorageLevel.MEMORY_AND_DISK_DESER))
        return old[-1]

    # the first tree is a single leaf, the start; margins change from round to round, blocks don't
    old, history = [blocks], []
    trees, weights = [Tree((n_rows, 1.0, margin0))], [1.0]
    margins = kept(blocks.map(lambda b: np.full(b[0].shape[1], margin0)))
    before = 0
    while True:
        todo = range(len(trees), min(rounds, before + chunk))
        if here and todo:
            seeds = [seed + m // BAG_ROUNDS for m in todo]
            made = kept(with_margins(blocks, margins).mapPartitions(
                rounds_here(bins, gradient, weighted, seeds, step, leaf_rows, depth)))
            trees += [t for part in made.filter(lambda x: isinstance(x, list)).collect() for t in part]
            weights += [step] * len(todo)
            margins = kept(made.filter(lambda x: not isinstance(x, list)))
        for m in () if here else todo:
            state = with_margins(blocks, margins)
            trees.append(grow(state, bins, gradient, seed + m // BAG_ROUNDS, depth, leaf_rows, weighted))
            weights.append(step)
            while len(old) > 2:
                old.pop(1).unpersist()
            margins = kept(state.map(advanced(trees[-1], step)))
        if judging:
            seen = stored(judged.mapInArrow(stepped(trees[before:], weights[before:], read),
                                            "n long, bins binary, label binary, margins binary"), "judged")
            block = seen.select("n", "label", "margins")
            history += judge(block.mapInArrow(rows_of(len(trees) - before), "label double, margins array<double>") if by_rows else block,
                             len(trees) - before)
            judged = seen.select("n", "bins", "label", F.expr("substring(margins, length(margins) - 8 * n + 1, 8 * n)").alias("margin"))
            if stop(history, patience)[1]:
                break
        if len(trees) >= rounds:
            break
        before = len(trees)
        margins.checkpoint()
        margins.count()
        while len(old) > 2:
            old.pop(1).unpersist()
    for rdd in old:
        rdd.unpersist()
    best = stop(history, patience)[0] if history else len(trees) - 1
    return Boosted(ensemble(spark, trees[:best + 1], weights[:best + 1], bins, classifier), history, best)


# a grid of boosters ---------------------------------------------------------------
@dataclass
class Boosters:
    """The trees of each point of a grid, all over one table's bins."""

    points: list[dict]
    fits: list[list[Tree]]
    bins: Bins
    margin0: float

    def wapes(self, val: DataFrame) -> list[float]:
        """Each point's WAPE on ``val`` (features, label)."""
        run = units_errors([(t, p["step"]) for t, p in zip(self.fits, self.points)], self.margin0)
        *errors, size = (in_blocks(_plain(val), self.bins).rdd.map(unpacked(self.bins)).map(run)
                         .treeAggregate(np.zeros(len(self.fits) + 1), np.add, np.add))
        return [float(e / size) if size else float("inf") for e in errors]

    def model(self, spark: SparkSession, i: int = 0) -> GBTRegressionModel:
        """The point as an MLlib ensemble."""
        trees, step = self.fits[i], self.points[i]["step"]
        return ensemble(spark, [Tree((1, 1.0, self.margin0)), *trees], [1.0, *[step] * len(trees)], self.bins, False)


def _plain(df: DataFrame) -> DataFrame:
    return df.select("features", F.col("label").cast("double").alias("label"), F.lit(1.0).alias("weight"),
                     F.monotonically_increasing_id().alias("row"))


def boosters(train: DataFrame, points: Sequence[dict], max_bins: int = 256) -> Boosters:
    """Fits each point (``rounds``, ``step``, ``leaf_rows``, ``depth`` or
    ``leaves``, ``l2``) to the residuals of ``train`` (features, label) from
    its mean on, without a bag. Up to ``POINT_ROWS`` rows each of several points
    has a task of its own (one point alone, up to ``HERE_ROWS``), which runs
    its rounds over all rows; larger tables are read in pieces, a job per
    level."""
    spark = train.sparkSession
    sc, points = spark.sparkContext, list(points)
    ship(spark)
    checkpoint_dir(spark)
    margin0, n_rows = start(train, False)
    bins = bins_of(train, max_bins)
    blocks = in_blocks(_plain(train), bins).rdd.map(unpacked(bins))
    if n_rows <= (POINT_ROWS if len(points) > 1 else HERE_ROWS):
        whole = blocks.coalesce(1).glom().persist(StorageLevel.MEMORY_AND_DISK_DESER)
        made = dict(sc.parallelize(list(enumerate(points)), len(points)).cartesian(whole).map(fits_here(bins, margin0)).collect())
        whole.unpersist()
        return Boosters(points, [made.get(i, []) for i in range(len(points))], bins, margin0)
    blocks = blocks._reserialize(ONE).coalesce(min(-(-n_rows // LEAST_PIECE), sc.defaultParallelism)).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    fits = []
    for point in points:
        how, trees, old = dict(point), [], []
        rounds, step = how.pop("rounds"), how.pop("step")
        margins = blocks.map(lambda b: np.full(b[0].shape[1], margin0))
        for m in range(rounds):
            margins = margins._reserialize(ONE).persist(StorageLevel.MEMORY_AND_DISK_DESER)
            old.append(margins)
            if m and not m % CHUNK:  # lineage doesn't grow
                margins.checkpoint()
                margins.count()
            state = with_margins(blocks, margins)
            trees.append(grow(state, bins, residual, None, how.get("depth"), how["leaf_rows"], False, how.get("leaves"), how.get("l2", 0.0)))
            while len(old) > 1:
                old.pop(0).unpersist()
            margins = state.map(advanced(trees[-1], step))
        for rdd in old:
            rdd.unpersist()
        fits.append(trees)
    blocks.unpersist()
    return Boosters(points, fits, bins, margin0)
