"""Cleaning, filters and top-k selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the columns of an enriched panel, in order
PANEL_COLUMNS = (
    "open high low close volume dividends splits ret_1d ret_5d ret_21d ret_63d ret_252d rsi_14 pct_from_52w_high vol_21d roe net_margin debt_to_equity "
    "earnings_surprise revenue_surprise pe_ratio pb_ratio ps_ratio ev_ebitda analyst_revision_3m dividend_yield fcf_yield vix yield_10y yield_2y "
    "credit_spread yield_curve sector sentiment_score gap_1d ret_10d sector_ret_1d days_since_earnings"
).split()


def conform(df: DataFrame, key: tuple[str, ...] = ("date", "ticker"), columns: list[str] = PANEL_COLUMNS) -> DataFrame:
    """The panel columns in order, doubles but for the sector; what df lacks is NULL, what it has besides goes."""
    kind = lambda c: "string" if c == "sector" else "double"
    return df.select(*key, *[(F.col(c) if c in df.columns else F.lit(None)).cast(kind(c)).alias(c) for c in columns])


def keep_one(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """First row of each key in a total order; reverse the order to keep the last."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__k = 1").drop("__k")


def at_least_rows(df: DataFrame, by: str, n: int) -> DataFrame:
    return df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(by))).where(F.col("__n") >= n).drop("__n")


def redact(text: str | Column) -> Column:
    """Keys in request lines are written over."""
    return F.regexp_replace(text, r"(?i)apikey=[^&\s]+", "apikey=***")


def number(text: str | Column) -> Column:
    """A number in dirty text, NULL where there is none."""
    return F.expr(f"try_cast({text} as double)") if isinstance(text, str) else text.try_cast("double")


def top_quantile(df: DataFrame, score: str, by: list[str], q: float = 0.8, at_least: int = 5) -> DataFrame:
    """Rows at or above the linear q-quantile of their group (ties included) with equal weight; groups under at_least names give none."""
    w = Window.partitionBy(*by)
    cut = df.where(F.col(score).isNotNull()).withColumn("__q", F.expr(f"percentile({score}, {q})").over(w)).withColumn("__n", F.count(F.lit(1)).over(w))
    top = cut.where((F.col("__n") >= at_least) & (F.col(score) >= F.col("__q")))
    return top.withColumn("weight", 1 / F.count(F.lit(1)).over(w)).drop("__q", "__n")


def top_share(df: DataFrame, score: str, by: list[str], tie: list[str], share: float = 0.1) -> DataFrame:
    """The max(1, floor(n * share)) best of each group; ties by the named columns."""
    w = Window.partitionBy(*by)
    ranked = df.where(F.col(score).isNotNull()).withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__k", F.row_number().over(w.orderBy(F.col(score).desc(), *tie)))
    return ranked.where(F.col("__k") <= F.greatest(F.lit(1), F.floor(F.col("__n") * share))).drop("__n", "__k")
