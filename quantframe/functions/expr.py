"""Column helpers with one meaning for missing values: SQL NULL, never NaN."""

from __future__ import annotations

from collections.abc import Iterable
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EULER = 0.5772156649015329


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in all floating columns, as every scan of foreign data should."""
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def div(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(col(a), F.nullif(col(b), F.lit(0)))


def change(now: Column, before: Column) -> Column:
    return div(now, before) - 1


def surprise(actual: str | Column, expected: str | Column) -> Column:
    """(actual - expected) / |expected|, NULL where expected is 0."""
    return div(col(actual) - col(expected), F.abs(col(expected)))


def pct_rank(x: str | Column, by: Iterable[str]) -> Column:
    """Average-rank share among non-null values of a group; NULL stays NULL."""
    x, by = col(x), list(by)
    order = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    ties = Window.partitionBy(*by, x)
    n = F.count(x).over(Window.partitionBy(*by))
    return F.when(x.isNotNull(), (F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2) / n)


def z_score(x: str | Column, by: Iterable[str]) -> Column:
    """(x - mean) / population deviation of a group, 0 where the deviation is 0 or unknown."""
    x, w = col(x), Window.partitionBy(*by)
    return F.coalesce(div(x - F.avg(x).over(w), F.stddev_pop(x).over(w)), F.lit(0.0))


def full(frame_value: Column, x: Column, w, at_least: int) -> Column:
    """A window value only where its frame holds `at_least` non-null x."""
    return F.when(F.count(x).over(w) >= at_least, frame_value)


def skew(x: str | Column) -> Column:
    """Bias-corrected skewness; NULL below 3 values or without spread."""
    n = F.count(col(x))
    return F.when((n > 2) & (F.stddev_pop(col(x)) > 0), F.skewness(col(x)) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt(x: str | Column) -> Column:
    """Bias-corrected excess kurtosis; NULL below 4 values or without spread."""
    n = F.count(col(x))
    return F.when((n > 3) & (F.stddev_pop(col(x)) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(col(x)) + 6))


def _cdf(z: pd.Series) -> pd.Series:
    cdf = NormalDist().cdf
    return z.map(lambda v: None if pd.isna(v) else cdf(v)).astype(float)


def _quantile(p: pd.Series) -> pd.Series:
    q = NormalDist().inv_cdf
    return p.map(lambda v: q(v) if not pd.isna(v) and 0 < v < 1 else None).astype(float)


def normal_cdf(z: str | Column) -> Column:
    """Standard normal distribution function."""
    return F.pandas_udf(_cdf, DoubleType())(col(z))


def normal_quantile(p: str | Column) -> Column:
    """Standard normal quantile; NULL outside (0, 1)."""
    return F.pandas_udf(_quantile, DoubleType())(col(p))
