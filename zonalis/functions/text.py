"""Number and coordinate text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_text(x: Column) -> Column:
    """Plain decimal text of a double: no exponent, and no ``.0`` on a whole number."""
    plain = (F.abs(x) >= 1e-3) & (F.abs(x) < 1e7)
    spelled = F.coalesce(
        F.regexp_replace(x.try_cast("decimal(38,20)").cast("string"), r"\.?0+$", ""), x.cast("string")
    )
    return (
        F.when(x == 0, F.lit("0"))
        .when(plain, F.regexp_replace(x.cast("string"), r"\.0$", ""))
        .otherwise(spelled)
    )


def percent_text(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` as a percentage with two decimals; NULL for an empty whole."""
    return F.format_string("%.2f%%", F.try_divide(part * F.lit(100.0), whole))
