"""Registry of the named queries run by the driver and the benchmark.

Each entry is a Spark job over the stand-in tables of one scale-factor folder
plus the equivalent DuckDB SQL (the oracle). Spark results get their double
columns rounded with the same IEEE steps the SQL uses, so the two engines
compare exactly unless a sum straddles a rounding edge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import ROUND_NUDGE, round_doubles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

ROUND_DIGITS = 6


def R(x: str, digits: int = ROUND_DIGITS) -> str:
    """SQL text of the oracle's rounding (mirrors ``stable_round``)."""
    s = float(10 ** digits)
    return f"CAST(floor(({x}) * {s!r} + {0.5 + ROUND_NUDGE!r}) / {s!r} AS DOUBLE)"


def query(name: str, sql: str | None = None, digits: int = ROUND_DIGITS):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir), digits)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return deco
