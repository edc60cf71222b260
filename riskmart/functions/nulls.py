"""Null-safe column builders.

The reference computes with pandas, whose missing-value rules differ from
Spark's in several silent ways; each helper pins one rule:

* NaN is a value in Spark (NaN > 0 is true, NaN is the largest double), a
  missing marker in pandas -> ``nan_to_null`` at the scan.
* a group sum over only missing values is 0.0 in pandas -> ``sum_or_zero``.
* a conditional count over only missing values is 0 -> ``count_true``.
* clipping keeps a missing value missing -> ``clip_lower``.
* division by zero is +-inf in pandas, an error under ANSI -> ``safe_div``
  (NULL instead).
* row mean/min/max skip missing values -> ``row_mean`` / ``row_min`` /
  ``row_max``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_null(x) -> Column:
    x = _c(x)
    return F.when(~F.isnan(x), x)


def nan_to_null_all(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column (a CSV text ``NaN`` reads
    as a NaN double in Spark)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(nan_to_null(f.name).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def safe_div(a, b) -> Column:
    return F.try_divide(_c(a), _c(b))


def clip_lower(x, lower=0) -> Column:
    x = _c(x)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(lower)))


def row_mean(cols) -> Column:
    cols = [_c(c) for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.when(n > 0, total / n)


def row_min(cols) -> Column:
    return F.least(*[_c(c) for c in cols])


def row_max(cols) -> Column:
    return F.greatest(*[_c(c) for c in cols])


def sum_or_zero(x) -> Column:
    return F.coalesce(F.sum(_c(x)), F.lit(0.0))


def count_true(cond: Column) -> Column:
    return F.count_if(cond)


def negative_days_to_years(x) -> Column:
    """-x/365 for a negative day offset, else 0 (a positive sentinel and a
    missing value both give 0)."""
    x = _c(x)
    return F.when(x < 0, -x / 365).otherwise(F.lit(0.0))
