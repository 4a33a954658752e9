"""Running totals in a global order, and exact percentiles, without a
single-partition window.

A window without ``partitionBy`` (or partitioned by a hot key) moves every row
into one task. Running totals range-partition the rows on the order key
(Spark samples the keys, so a hot group is spread over many ranges), write
each row with the number of its range, and read that table twice: once for
the total of each range (one row per range, a proven bound), once for running
sums inside a range. The range of a row is decided once and stored, so both
readers agree however the plans are pruned, and a lost executor cannot move a
row to another range.

Exact percentiles bracket each rank between two values of a mergeable
quantile sketch, then count what lies below the bracket and rank exactly the
few values inside. Nothing that grows with the input is written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import stored

_BKT = "_rng_bucket"


def _order_cols(order: Sequence) -> list[Column]:
    out = []
    for o in order:
        if isinstance(o, tuple):
            c, asc = o
            c = F.col(c) if isinstance(c, str) else c
            out.append(c.asc() if asc else c.desc())
        else:
            out.append(F.col(o).asc() if isinstance(o, str) else o)
    return out


def _same(a: DataFrame, b: DataFrame, cols: Sequence[str], prefix: str) -> Column | None:
    """Null-safe equality of the group columns (``prefix`` marks those of b)."""
    cond = None
    for c in cols:
        eq = a[c].eqNullSafe(b[f"{prefix}{c}"])
        cond = eq if cond is None else cond & eq
    return cond


def running_totals(df: DataFrame, order: Sequence, sums: Sequence[str],
                   by: Sequence[str] = (), buckets: int | None = None,
                   prefix: str = "cum_", following: bool = False) -> DataFrame:
    """Add ``{prefix}{s}`` = Σ s over rows up to and including this one in
    ``order`` (within ``by`` groups; a null group is a group), plus
    ``total_{s}`` per group.

    Rows must be distinct on (by, order) — collapse ties first (aggregate to
    one row per distinct key), which is what every caller does. With
    ``following``, ``next_{s}`` is the value of s in the next row (null for
    the last): inside a range by the window that has the running sums, at its
    end the first value of the range behind it.
    """
    spark = df.sparkSession
    by = list(by)
    nb = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ocols = _order_cols(order)
    ranged = stored(df.repartitionByRange(nb, *[F.col(b) for b in by], *ocols)
                      .withColumn(_BKT, F.spark_partition_id()), "ranges")
    # one row per (group, range): bounded by buckets + number of groups
    inner = W.partitionBy(*by, _BKT).orderBy(*ocols)
    numbered = ranged
    if following:
        numbered = ranged.select("*", (F.row_number().over(inner) == 1).alias("_head"),
                                 *[F.lead(s).over(inner).alias(f"_n_{s}") for s in sums])
    heads = [F.max(F.when(F.col("_head"), F.col(s))).alias(f"_f_{s}") for s in sums if following]
    totals = numbered.groupBy(*by, _BKT).agg(*[F.sum(s).alias(f"_t_{s}") for s in sums], *heads)
    wb = W.partitionBy(*by).orderBy(_BKT) if by else W.orderBy(_BKT)
    offsets = totals.select(
        *[F.col(b).alias(f"_g_{b}") for b in by], F.col(_BKT).alias(f"_g_{_BKT}"),
        *[F.coalesce(F.sum(f"_t_{s}").over(wb.rowsBetween(W.unboundedPreceding, -1)),
                     F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(W.partitionBy(*by) if by else W.partitionBy())
          .alias(f"total_{s}") for s in sums],
        *[F.lead(f"_f_{s}").over(wb).alias(f"_b_{s}") for s in sums if following])
    if not by:
        offsets = F.broadcast(offsets)  # at most `nb` rows
    within = numbered.select("*", *[F.sum(s).over(inner.rowsBetween(W.unboundedPreceding, 0)).alias(f"_i_{s}") for s in sums])
    out = within.join(offsets, _same(within, offsets, [_BKT, *by], "_g_"), "inner")
    return out.select(
        *[within[c] for c in df.columns],
        *[(F.col(f"_o_{s}") + F.col(f"_i_{s}")).alias(f"{prefix}{s}") for s in sums],
        *[F.col(f"total_{s}") for s in sums],
        *[F.coalesce(F.col(f"_n_{s}"), F.col(f"_b_{s}")).alias(f"next_{s}") for s in sums if following])


# The sketch's rank error is 1 / accuracy of a group's rows; a bracket is four
# times as wide on either side. Groups of fewer rows than the accuracy are
# inside whole.
SKETCH_ACCURACY = 10_000


# Counted values that one task per group orders; more go through ranges.
FEW_CELLS = 200_000


def _brackets(vals: DataFrame, probs: Sequence[float], by: Sequence[str], accuracy: int) -> tuple[DataFrame, Column, list, list]:
    """The rows with, for each probability, two values that the wanted rank
    should lie between; whole groups of up to ``accuracy`` rows."""
    side = 4.0 / accuracy
    ends = [max(0.0, p - side) for p in probs] + [min(1.0, p + side) for p in probs]
    sketch = vals.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"),
                                   F.percentile_approx("_v", ends, accuracy).alias("_q"))
    k = len(probs)
    if by:
        # one row per group; broadcast only if its stored size is under the planner's threshold
        sketch = stored(sketch.select(*[F.col(b).alias(f"_g_{b}") for b in by], "_rows", "_q"), "sketch")
        rows = vals.join(sketch, _same(vals, sketch, by, "_g_")).select(*[vals[b] for b in by], "_v", "_rows", "_q")
        return rows, F.col("_rows"), [F.col("_q")[j] for j in range(k)], [F.col("_q")[k + j] for j in range(k)]
    one = sketch.first()  # one row of 2 x probs numbers
    q = one["_q"] or [None] * (2 * k)
    return vals, F.lit(one["_rows"]), [F.lit(x).cast("double") for x in q[:k]], [F.lit(x).cast("double") for x in q[k:]]


def exact_percentiles(df: DataFrame, value: str, probs: Sequence[float],
                      by: Sequence[str] = (), buckets: int | None = None,
                      accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """Linear-interpolated percentiles (pandas ``quantile`` / SQL
    ``quantile_cont``) of ``value`` per ``by`` group (a null group is a group).

    Returns one row per (group, prob): ``*by, prob, value``. Two passes over
    the input, both map-side combined: the sketch, then one that collapses
    values inside a bracket to (group, value) counts and all others to counts
    by the brackets they lie below. The counts say whether every wanted rank
    lies inside its bracket; where one doesn't, the brackets are made four
    times as wide and counted again (at last they hold every row).
    """
    by = list(by)
    probs = [float(p) for p in probs]
    vals = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))

    def flags(x):
        return F.when(x, F.lit(1)).otherwise(F.lit(0)).cast("byte")

    while True:
        rows, total, lo, hi = _brackets(vals, probs, by, accuracy)
        small = total <= F.lit(accuracy)
        inside = [small | ((F.col("_v") >= lo[j]) & (F.col("_v") <= hi[j])) for j in range(len(probs))]
        below = [~small & (F.col("_v") < lo[j]) for j in range(len(probs))]
        any_inside = inside[0]
        for x in inside[1:]:
            any_inside = any_inside | x
        cells = stored(rows.groupBy(*by, F.when(any_inside, F.col("_v")).alias("_v"),
                                    F.array(*[flags(x) for x in inside]).alias("_in"),
                                    F.array(*[flags(x) for x in below]).alias("_below"))
                       .agg(F.count(F.lit(1)).alias("_n")), "cells")
        each = cells.select(*by, "_v", "_n", F.explode(F.array(*[
            F.struct(F.lit(j).alias("_j"), F.lit(p).alias("_p"), F.col("_in")[j].alias("_inside"),
                     F.col("_below")[j].alias("_under")) for j, p in enumerate(probs)])).alias("_e"))
        each = each.select(*by, "_v", "_n", "_e.*")
        base = each.groupBy(*by, "_j").agg(
            F.sum(F.col("_n") * F.col("_under")).alias("_base"), F.sum("_n").alias("_rows"),
            F.sum(F.col("_n") * F.col("_inside")).alias("_held"), F.sum("_inside").alias("_cells"), F.max("_p").alias("_prob"))
        rank = (F.col("_rows") - 1).cast("double") * F.col("_prob")
        missed = (F.floor(rank) < F.col("_base")) | (F.ceil(rank) >= F.col("_base") + F.col("_held"))
        check = base.agg(F.coalesce(F.sum(missed.cast("int")), F.lit(0)).alias("missed"),
                         F.coalesce(F.sum("_cells"), F.lit(0)).alias("cells")).first()
        if not check["missed"]:
            break
        accuracy = max(1, accuracy // 4)
    base = base.select(*[F.col(b).alias(f"_g_{b}") for b in by], F.col("_j").alias("_g__j"), "_base", "_rows")
    counts = each.where("_inside = 1").groupBy(*by, "_j", "_p", "_v").agg(F.sum("_n").alias("_n"))
    if check["cells"] <= FEW_CELLS:
        order = W.partitionBy(*by, "_j").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
        cum = counts.withColumn("cum__n", F.sum("_n").over(order))
    else:
        cum = running_totals(counts, ["_v"], ["_n"], by=[*by, "_j"], buckets=buckets)
    cum = cum.join(base, _same(cum, base, [*by, "_j"], "_g_"))
    pos = (F.col("_rows") - 1).cast("double") * F.col("_p")
    rows = cum.select(*[cum[b] for b in by], "_p", "_v", (F.col("_base") + F.col("cum__n") - F.col("_n")).alias("_first"),
                      (F.col("_base") + F.col("cum__n") - 1).alias("_last"), F.floor(pos).alias("_klo"),
                      F.ceil(pos).alias("_khi"), (pos - F.floor(pos)).alias("_frac"))
    lo_hit = (F.col("_klo") >= F.col("_first")) & (F.col("_klo") <= F.col("_last"))
    hi_hit = (F.col("_khi") >= F.col("_first")) & (F.col("_khi") <= F.col("_last"))
    agg = rows.where(lo_hit | hi_hit).groupBy(*by, "_p").agg(
        F.max(F.when(lo_hit, F.col("_v"))).alias("_lo"), F.max(F.when(hi_hit, F.col("_v"))).alias("_hi"),
        F.max("_frac").alias("_frac"))
    return agg.select(*by, F.col("_p").alias("prob"),
                      (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")).alias("value"))


def percentile_row(df: DataFrame, value: str, probs: dict[str, float]) -> DataFrame:
    """Global percentiles as one row with one column per name."""
    p = exact_percentiles(df, value, list(probs.values()))
    return p.agg(*[F.max(F.when(F.col("prob") == F.lit(float(v)), F.col("value"))).alias(k)
                   for k, v in probs.items()])


def group_percentile(df: DataFrame, value: str, prob: float, by: Sequence[str],
                     name: str) -> DataFrame:
    """One row per group with the ``prob`` percentile of ``value`` as ``name``."""
    return exact_percentiles(df, value, [prob], by=by).select(*by, F.col("value").alias(name))


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row of ``df`` as a
    scalar subquery (Spark runs it once and inlines the result; no join)."""
    cols = one_row.columns
    packed = one_row.select(F.struct(*cols).alias("_s")).scalar()
    return df.select("*", packed.alias("_scalars")).select(
        *[F.col(c) for c in df.columns], *[F.col(f"_scalars.{c}").alias(c) for c in cols])


def join_one_row(a: DataFrame, b: DataFrame) -> DataFrame:
    """Put the columns of two single-row global aggregates side by side."""
    return with_scalars(a, b)
