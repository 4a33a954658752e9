"""Column expressions (the scalar functions of the pipeline).

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so
it stays inside whole-stage codegen; no Python UDFs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# C1 ------------------------------------------------------------------------
def normalize_key(c, width: int = P.ARTICLE_ID_WIDTH) -> Column:
    """Text key left-padded with zeros to ``width``; longer keys kept whole
    (``lpad`` alone would truncate them)."""
    s = col(c).cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


# C2 / C3 -------------------------------------------------------------------
def week_start(c) -> Column:
    """Monday of the week containing the date."""
    return F.date_trunc("week", col(c)).cast("date")


def month_start(c) -> Column:
    return F.trunc(col(c).cast("date"), "MM")


# C4 ------------------------------------------------------------------------
def iso_week(c) -> Column:
    return F.weekofyear(col(c))


def day_of_week_monday0(c) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6."""
    return F.weekday(col(c))


# C5 ------------------------------------------------------------------------
def month_sin(month) -> Column:
    return F.sin(F.lit(2 * math.pi) * col(month) / F.lit(12.0))


def month_cos(month) -> Column:
    return F.cos(F.lit(2 * math.pi) * col(month) / F.lit(12.0))


# C7 ------------------------------------------------------------------------
def invert_log(c) -> Column:
    """expm1 of a log-scale prediction, clipped at zero."""
    return F.greatest(F.expm1(col(c)), F.lit(0.0))


# C9 ------------------------------------------------------------------------
def lookup_rate(c, rates: Mapping[str, float], default: float) -> Column:
    """Map a category to its rate, ``default`` for anything not in ``rates``."""
    m = F.create_map(*[x for k, v in rates.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(m[col(c)], F.lit(float(default)))


# C10 / C11 / C12 -------------------------------------------------------------
def price_factor(price, group_median) -> Column:
    """1.15 above the group median, else 0.95 (null comparisons fall to else)."""
    return F.when(col(price) > col(group_median), F.lit(P.PRICE_FACTOR_HIGH)).otherwise(
        F.lit(P.PRICE_FACTOR_LOW))


def engagement_factor(status) -> Column:
    return F.when(col(status).isin(*P.ENGAGED_STATUSES), F.lit(P.ENGAGED_FACTOR)).otherwise(
        F.lit(P.NOT_ENGAGED_FACTOR))


def clip(c, lo: float | None = None, hi: float | None = None) -> Column:
    out = col(c)
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return out


# C17 -----------------------------------------------------------------------
def error(y, yhat) -> Column:
    return col(yhat) - col(y)


# C19 -----------------------------------------------------------------------
def risk_tier(c, bounds=P.TIER_BOUNDS, labels=("low", "mid", "high")) -> Column:
    """Left-closed tiers: < b0, [b0, b1), >= b1."""
    lo, hi = bounds
    x = col(c)
    return (F.when(x < lo, F.lit(labels[0]))
            .when(x < hi, F.lit(labels[1]))
            .when(x >= hi, F.lit(labels[2])))


# C20 -----------------------------------------------------------------------
LABEL_SEP = "  ·  "


def product_label(article_id, type_name, colour) -> Column:
    return F.concat_ws(LABEL_SEP, col(article_id), F.coalesce(col(type_name), F.lit("?")),
                       F.coalesce(col(colour), F.lit("?")))


def label_to_id(label) -> Column:
    return F.split(col(label), LABEL_SEP, 2)[0]


# K1 / K2 / E9 ----------------------------------------------------------------
def equal_width_bin(c, lo, hi, bins: int) -> Column:
    """1-based equal-width bin of [lo, hi]: floor((x - lo) / (hi - lo) * n) + 1,
    the top edge joining the last bin; one bin when hi == lo. ``lo`` / ``hi``
    may be literals or columns."""
    lo = F.lit(float(lo)) if isinstance(lo, (int, float)) else lo
    hi = F.lit(float(hi)) if isinstance(hi, (int, float)) else hi
    pos = F.floor(F.try_divide(col(c) - lo, hi - lo) * F.lit(float(bins))).cast("int") + F.lit(1)
    return F.when(hi == lo, F.lit(1)).otherwise(F.least(F.lit(bins), pos))


def right_closed_bin(c, step, bins: int) -> Column:
    """Right-closed bins (0, s], (s, 2s], ...; the lowest edge joins bin 1."""
    return F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil(col(c) / step).cast("int")))


# Output rounding -------------------------------------------------------------
ROUND_NUDGE = 1e-3


def stable_round(c, digits: int = 6) -> Column:
    """floor(x*10^d + 0.5 + nudge)/10^d: the same IEEE steps as the SQL
    oracle. The small nudge moves the rounding edge off exact decimal ties
    (averages of decimal data often land exactly on ...5), where two engines
    whose sums differ in the last bit would otherwise round apart."""
    s = float(10 ** digits)
    return (F.floor(col(c) * F.lit(s) + F.lit(0.5 + ROUND_NUDGE)) / F.lit(s)).cast("double")


def round_doubles(df: DataFrame, digits: int = 6, skip: Iterable[str] = ()) -> DataFrame:
    skip = set(skip)
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float") and f.name not in skip:
            out.append(stable_round(F.col(f.name), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# C21 -----------------------------------------------------------------------
def percent_text(c, decimals: int = 1) -> Column:
    """x as a percentage string with fixed decimals, e.g. 0.3521 -> '35.2%'."""
    return F.format_string(f"%.{decimals}f%%", F.bround(col(c) * F.lit(100.0), decimals))


def export_view(df: DataFrame, rename: dict, pct: dict | None = None, keep: dict | None = None,
                round_cols: dict | None = None) -> DataFrame:
    """Pick and rename columns for export; ``pct`` columns become percent
    text, ``round_cols`` {col: (name, digits)} are rounded (half to even)."""
    out = [F.col(k).alias(v) for k, v in rename.items()]
    out += [percent_text(k).alias(v) for k, v in (pct or {}).items()]
    out += [F.bround(F.col(k), d).alias(v) for k, (v, d) in (round_cols or {}).items()]
    out += [F.col(k).alias(v) for k, v in (keep or {}).items()]
    return df.select(*out)
