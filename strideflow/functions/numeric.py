from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, null when den is 0 (Spark 4 ANSI mode raises otherwise)."""
    return num / F.nullif(den, F.lit(0))


def rnd(col: Column | str, dp: int) -> Column:
    """Round a numeric column as double to ``dp`` places, half away from 0.

    The value is first rounded to 10 places, so float noise from summation
    order (27.284999999999997 vs 27.285000000000004) cannot flip a decimal
    tie; the result is stable across engines and partitionings.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.round(F.round(c.cast("double"), 10), dp)
