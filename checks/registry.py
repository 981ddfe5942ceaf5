"""Register queries together with their oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def r6(x, digits: int = 6) -> Column:
    """Round to 6 decimals; adding 0.0 turns a negative zero into zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE column.

    Means over a power of two of pixels end in a 5 at the seventh decimal, where the last bit of a sum
    decides the rounding; those are compared to 9 decimals.
    """
    return df.select(*[r6(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
