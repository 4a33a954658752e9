"""Sorts, limits, top-k, distinct values, pivots, histograms and samples
(K0-K2, T-a..T-h, R1-R3, X1-X2).

Top-k is ``orderBy(...).limit(k)``, which Spark plans as
TakeOrderedAndProject: each partition keeps its own k best rows and only
those k x partitions rows reach the final merge. Every ordering carries a
key tie-break so results are deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import columns as C
from ..functions.random import uniform
from ..session import stored
from .prefix import percentile_row, with_scalars


def top_k(df: DataFrame, k: int, by: str, ascending: bool = False, key: str = "article_id") -> DataFrame:
    o = F.col(by).asc() if ascending else F.col(by).desc()
    return df.orderBy(o, F.col(key).asc()).limit(k)


# T-a -------------------------------------------------------------------------
def extreme_months(monthly: DataFrame, busiest: int = 5, quietest: int = 3,
                   col: str = "n_transactions") -> DataFrame:
    hi = monthly.orderBy(F.col(col).desc(), F.col("month").asc()).limit(busiest) \
        .withColumn("kind", F.lit("busiest"))
    lo = monthly.orderBy(F.col(col).asc(), F.col("month").asc()).limit(quietest) \
        .withColumn("kind", F.lit("quietest"))
    return hi.unionByName(lo)


# T-b -------------------------------------------------------------------------
def top_article_series(pred: DataFrame, k: int = 6, key: str = "article_id",
                       y: str = "units_sold") -> DataFrame:
    """Weekly rows of the k best-selling articles (semi-join on k keys)."""
    top = (pred.groupBy(key).agg(F.sum(y).alias("_total"))
               .orderBy(F.col("_total").desc(), F.col(key).asc()).limit(k).select(key))
    return pred.join(F.broadcast(top), key, "left_semi")


# T-f -------------------------------------------------------------------------
def top_k_in_group(df: DataFrame, k: int, group: str, by: str, key: str = "article_id") -> DataFrame:
    """The k highest ``by`` rows of every group, with their rank. A
    rank-limited window: Spark pushes the limit below the shuffle
    (WindowGroupLimit), so each map task ships at most k rows per group."""
    w = W.partitionBy(group).orderBy(F.col(by).desc(), F.col(key).asc())
    return (df.where(F.col(group).isNotNull()).withColumn("rank", F.row_number().over(w))
              .where(F.col("rank") <= k))


# R1 -------------------------------------------------------------------------
def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


# R2 -------------------------------------------------------------------------
def stack(dfs: Sequence[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


# R3 -------------------------------------------------------------------------
def pivot_matrix(cells: DataFrame, row: str, column: str, value: str,
                 values: Sequence[str]) -> DataFrame:
    """Wide matrix with an explicit column list (no extra job to discover
    the values, fixed schema); missing cells are null."""
    return cells.groupBy(row).pivot(column, list(values)).agg(F.first(value))


# K1 -------------------------------------------------------------------------
def histogram(df: DataFrame, col: str, bins: int, lo: float, hi: float) -> DataFrame:
    """Equal-width counts on [lo, hi] (values outside are not counted)."""
    x = F.col(col)
    return (df.where((x >= lo) & (x <= hi))
              .select(C.equal_width_bin(col, lo, hi, bins).alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
              .select("bin", (F.lit(float(lo)) + (F.col("bin") - 1) * F.lit((hi - lo) / bins)).alias("bin_lo"),
                      "count"))


def histogram_to_quantile(df: DataFrame, col: str, bins: int, q: float = 0.99,
                          lo: float = 0.0) -> DataFrame:
    """Equal-width bins of which ``bins`` cover [lo, p_q], p_q the exact
    q-quantile. All rows are binned: those beyond p_q (or below ``lo``) get
    the bins that follow (or precede) at the same width, so a display zoomed
    to p_q shows the first ``bins`` and nothing is lost."""
    hi = percentile_row(df, col, {"_hi": q})
    x = with_scalars(df.select(col), hi)
    width = (F.col("_hi") - F.lit(float(lo))) / F.lit(float(bins))
    at = F.floor((F.col(col) - F.lit(float(lo))) / width).cast("int") + 1
    b = F.when(F.col(col) == F.col("_hi"), F.lit(bins)).otherwise(at)
    return (x.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count")))


# X1, X2 ---------------------------------------------------------------------
# A draw is a whole number of 32 bits. Its first 13 bits are its cell; a cell
# that a sample ends in is divided by the next bits while it holds more rows
# than one task orders.
_SHIFTS = (19, 6, 0)
FEW_ROWS = 100_000


def _draw(keys: Sequence[str], salt: str) -> Column:
    return F.floor(uniform(list(keys), salt) * F.lit(float(2 ** 32))).cast("long")


def _cuts(df: DataFrame, by: Sequence[str], keys: Sequence[str], salt: str, quota: Column, few: int = FEW_ROWS) -> DataFrame:
    """The last row that each group's sample takes, in the order of draw and
    keys: ``by``, ``_draw``, ``_last`` (a struct of the keys); ``quota`` of
    the group's row count ``_size`` is its sample's size, and a group that
    takes no row has no cut. Only ``by`` and ``keys`` are read; of the rows,
    only those of the cells that the samples end in are ordered."""
    rows = df.select(*dict.fromkeys([*by, *keys])).withColumn("_draw", _draw(keys, salt))
    whole = W.partitionBy(*by) if by else W.partitionBy()
    ends, inside = None, rows
    for shift in _SHIFTS:
        # at most 8,192 cells a group
        cells = inside.groupBy(*by, *(["_rest"] if ends is not None else []), F.shiftright("_draw", shift).alias("_cell")).agg(
            F.count(F.lit(1)).alias("_n"))
        if ends is None:
            cells = cells.withColumn("_size", F.sum("_n").over(whole)).withColumn("_rest", quota.cast("long"))
        upto = F.sum("_n").over(whole.orderBy("_cell").rowsBetween(W.unboundedPreceding, 0))
        ends = stored(cells.withColumn("_upto", upto)
                      .where((F.col("_upto") >= F.col("_rest")) & (F.col("_upto") - F.col("_n") < F.col("_rest")))
                      .select(*[F.col(b).alias(f"_g_{b}") for b in by], "_cell", "_n",
                              (F.col("_rest") - F.col("_upto") + F.col("_n")).alias("_rest")), "cuts")
        same = F.shiftright(rows["_draw"], shift) == ends["_cell"]
        for b in by:
            same = same & rows[b].eqNullSafe(ends[f"_g_{b}"])
        inside = rows.join(ends, same).select(*[rows[c] for c in rows.columns], "_rest")
        if (ends.agg(F.max("_n")).first()[0] or 0) <= few:
            break
    rank = F.row_number().over(whole.orderBy("_draw", *keys))
    return inside.withColumn("_rank", rank).where("_rank = _rest").select(*by, "_draw", F.struct(*keys).alias("_last"))


def _taken(draw: Column, keys: Sequence[str], cut: Column, last: Column) -> Column:
    return (draw < cut) | ((draw == cut) & (F.struct(*keys) <= last))


def sample_n(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42, few: int = FEW_ROWS) -> DataFrame:
    """Exact-n sample without replacement: the n rows with the smallest
    seeded hash of their keys, which identify a row (independent of
    partitioning). A count table over cells of the hash finds the cell that
    the n-th row is in, that cell is ordered, and the sample is a filter of
    the scan: no payload is shuffled or written."""
    salt = f"sample:{seed}"
    if n <= 0:
        return df.limit(0)
    cut = _cuts(df, [], keys, salt, F.least(F.lit(int(n)), F.col("_size")), few).first()
    if cut is None:  # no rows
        return df
    names = list(keys)
    last = F.struct(*[F.lit(cut["_last"][k]).cast(df.schema[k].dataType).alias(k) for k in names])
    return df.where(_taken(_draw(names, salt), names, F.lit(cut["_draw"]), last))


def sample_stratified(df: DataFrame, strata: str, fraction: float, keys: Sequence[str],
                      seed: int = 42, few: int = FEW_ROWS) -> DataFrame:
    """Keep ceil(fraction x stratum size) rows of each stratum (a null
    stratum is one), those with the smallest seeded hash of their keys. The
    cuts are found as for ``sample_n``, one row per stratum, and joined to the
    scan; the planner broadcasts them if they are under its size threshold."""
    salt, names = f"strat:{seed}", list(keys)
    quota = F.ceil(F.col("_size") * F.lit(float(fraction)))
    cuts = stored(_cuts(df, [strata], names, salt, quota, few), "cuts").withColumnRenamed(strata, "_stratum")
    kept = df[strata].eqNullSafe(cuts["_stratum"]) & _taken(
        _draw([df[k] for k in names], salt), [df[k] for k in names], cuts["_draw"], cuts["_last"])
    return df.join(cuts, kept, "left_semi")
