"""Reproducible random numbers keyed by row content.

``rand(seed)`` depends on how rows fall into partitions, so a re-run after an
executor loss (or with another partition count) would draw other numbers.
Here every draw is a pure function of (key columns, salt): the first 32 bits
of an md5 digest mapped into (0, 1); normals come from Box-Muller.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO32 = float(2 ** 32)
_HALF_STEP = float(2 ** -33)


def uniform(keys: list, salt: str) -> Column:
    """Uniform draw in (0, 1) from the key columns and a salt."""
    parts = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]
    digest = F.md5(F.concat_ws("|", *parts, F.lit(salt)))
    as_int = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return as_int / F.lit(_TWO32) + F.lit(_HALF_STEP)


def normal(keys: list, salt: str, mean: float = 0.0, std: float = 1.0) -> Column:
    u1 = uniform(keys, salt + "#1")
    u2 = uniform(keys, salt + "#2")
    z = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)
    return F.lit(float(mean)) + F.lit(float(std)) * z


def sql_uniform(keys_sql: list[str], salt: str) -> str:
    """DuckDB text of the same draw (for the SQL oracle)."""
    cat = "concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys_sql) + f", '{salt}')"
    return (f"(CAST(('0x' || substr(md5({cat}), 1, 8)) AS BIGINT)::DOUBLE / {_TWO32!r} "
            f"+ {_HALF_STEP!r})")


def sql_normal(keys_sql: list[str], salt: str, mean: float = 0.0, std: float = 1.0) -> str:
    u1 = sql_uniform(keys_sql, salt + "#1")
    u2 = sql_uniform(keys_sql, salt + "#2")
    return (f"({float(mean)!r} + {float(std)!r} * (sqrt(-2.0 * ln({u1})) * "
            f"cos({2 * math.pi!r} * {u2})))")
