"""Logarithms and powers of the C library.

The JVM has its own, which differ from it in the last bit. Tempos clamped to their bounds make exact ties (a rise and a fall by the same
ratio), and a fold that keeps the stronger of two follows that bit, so the values behind it come from here.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _each(f, *columns) -> pd.Series:
    """f of the values where all are above zero; null elsewhere."""
    return pd.Series([f(*v) if all(x > 0 for x in v) else None for v in zip(*columns)], dtype="float64")


@F.pandas_udf(DoubleType())
def _log(x: pd.Series) -> pd.Series:
    return _each(math.log, x)


@F.pandas_udf(DoubleType())
def _mean3(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return _each(lambda *v: math.pow(2.0, (math.log2(v[0]) + math.log2(v[1]) + math.log2(v[2])) / 3), a, b, c)


def log(x: Column) -> Column:
    return _log(x)


def geometric_mean(a: Column, b: Column, c: Column) -> Column:
    """2 to the mean of three binary logarithms; null where any is null or not above zero."""
    return _mean3(a, b, c)
