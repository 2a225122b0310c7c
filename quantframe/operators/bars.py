"""Value-driven bars and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import stored
from . import chains
from .windows import lag_calendar

BAR_COLUMNS = ("ticker", "ts", "open", "high", "low", "close", "volume", "dollar_volume")


def adtv(daily: DataFrame, days: int = 63) -> DataFrame:
    """(ticker, adtv): mean close * volume of the last bars."""
    k = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("date").desc()))
    return daily.withColumn("__k", k).where(F.col("__k") <= days).groupBy("ticker").agg(F.avg(F.col("close") * F.col("volume")).alias("adtv"))


def value_bars(ticks: DataFrame, thresholds: DataFrame, opened: DataFrame | None = None, unit: float = 1e-4, block_rows: int = chains.BLOCK_ROWS, doubles: bool = False) -> DataFrame:
    """Bars of equal traded value from ticks (ticker, ts, price, size) and thresholds (ticker, threshold), complete ones (done) and each ticker's open one.

    A bar ends at the first tick with which its value reaches the threshold; overshoot is not carried. Values count in
    whole `unit`s, so that where bars end does not depend on the order of additions; with `doubles` a bar whose units just
    reach the threshold ends only where its values do so too, added tick by tick as a loop over doubles (or SQL) adds
    them, and an open bar's dollar_volume is added in that way. opened: the open bars of earlier
    ticks, as this function gave them. Where a bar ends is found by pointers over blocks of ticks (see chains), so one
    ticker's ticks lie over many tasks; bars are then grouped sums. Prices and sizes are not negative; a tick without
    one of them is none; a threshold of 0 or less makes each tick a bar.
    """
    rows, held = _marked(ticks, thresholds, opened, unit, block_rows, doubles)
    rows = stored(rows, "bar-ticks") if doubles else rows
    new = _grouped(rows)
    if held is not None:
        both = new.withColumn("late", F.lit(1)).unionByName(held.select(*new.columns).withColumn("late", F.lit(0)))
        new = both.groupBy("ticker", "need").agg(
            F.max("done").alias("done"), F.min("ts").alias("ts"), F.min_by("open", "late").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", "late").alias("close"), F.sum("volume").alias("volume"), F.sum("dollar_volume").alias("dollar_volume"), F.sum("units").alias("units"),
        )
    if not doubles:
        return new.drop("need")
    new = stored(new, "bars")
    last = rows.join(new.where("not done").select("ticker", "need"), ["ticker", "need"]).withColumn("x", F.col("price") * F.col("size")).withColumn("x0", F.when(F.col("need") == F.col("first"), F.col("x0")).otherwise(0.0))
    reached = chains.ordered_sums(last.where("x <> 0"), ["ticker", "need"], "total", "x", "x0")
    return new.join(reached, ["ticker", "need"], "left").withColumn("dollar_volume", F.coalesce("reached", "dollar_volume")).drop("need", "reached")


def _marked(ticks: DataFrame, thresholds: DataFrame, opened: DataFrame | None, unit: float, block_rows: int, doubles: bool) -> tuple[DataFrame, DataFrame | None]:
    """Ticks with the need of their bar and whether they end it; the open bars with what they need."""
    units = lambda x: F.round(x / unit).cast("long")
    t = ticks.where("price is not null and size is not null").select("ticker", "ts", "price", "size").join(thresholds.select("ticker", "threshold"), "ticker")
    every = F.col("threshold") <= 0
    t = t.withColumn("step", F.when(every, 1).otherwise(F.greatest(units(F.col("threshold")), F.lit(1)))).withColumn("units", F.when(every, 1).otherwise(units(F.col("price") * F.col("size"))))
    held = None
    if opened is not None:
        held = opened.join(thresholds, "ticker").withColumn("need", F.greatest(F.greatest(units(F.col("threshold")), F.lit(1)) - F.col("units"), F.lit(1))).drop("threshold")
        t = t.join(held.select("ticker", F.col("need").alias("first"), F.col("dollar_volume").alias("x0")), "ticker", "left").withColumn("first", F.coalesce("first", "step")).withColumn("x0", F.coalesce("x0", F.lit(0.0)))
    else:
        t = t.withColumn("first", F.col("step")).withColumn("x0", F.lit(0.0))
    loop = (F.col("price") * F.col("size"), F.col("x0"), F.col("threshold")) if doubles else None
    t = t if doubles else t.drop("threshold", "x0")
    return chains.chain(t, "ticker", ["ts", "price", "size"], F.col("units"), F.col("step"), F.col("first"), F.lit(True), block_rows, loop), held


def _grouped(rows: DataFrame) -> DataFrame:
    order = F.struct("ts", "price", "size")
    return rows.groupBy("ticker", "need").agg(
        F.max("chosen").alias("done"), F.min("ts").alias("ts"), F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("size").alias("volume"), F.sum(F.col("price") * F.col("size")).alias("dollar_volume"), F.sum("units").alias("units"),
    )


def dollar_bars(ticks: DataFrame, thresholds: DataFrame, doubles: bool = False) -> DataFrame:
    """The complete bars of value_bars; the part bar at the end is left out."""
    rows, _ = _marked(ticks, thresholds, None, 1e-4, chains.BLOCK_ROWS, doubles)
    return _grouped(rows).where("done").select(*BAR_COLUMNS)


def equal_weight_benchmark(bars: DataFrame, floor: float = 5.0) -> DataFrame:
    """(date, ret): mean open-to-open return over names whose open a market day before was at least `floor`; the first day is left out."""
    p = lag_calendar(bars.where("open > 0"), "open", 1, "__p")
    return p.where(F.col("__p") >= floor).groupBy("date").agg(F.avg(F.col("open") / F.col("__p") - 1).alias("ret"))
