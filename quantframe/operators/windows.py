"""Per-ticker window features over bars (ticker, date, open, high, low, close, volume).

Row-based: a lag is a number of the ticker's own bars. Calendar-based helpers (`on_calendar`, `lag_calendar`)
count days of the whole market, so a missing bar gives NULL.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import change, col, div, full
from ..sources.files import stored

YEAR = 252


def by_ticker():
    return Window.partitionBy("ticker").orderBy("date")


def rows(n: int):
    """The ticker's last n rows, this one included."""
    return by_ticker().rowsBetween(-(n - 1), 0)


def lag(x: str | Column, n: int = 1) -> Column:
    return F.lag(x, n).over(by_ticker())


def filled(x: str | Column) -> Column:
    """Last known value up to this row."""
    return F.last(col(x), ignorenulls=True).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))


def lookback_returns(bars: DataFrame, horizons: tuple[int, ...] = (1, 5, 21, 63, 252)) -> DataFrame:
    """ret_<n>d = close / close n bars ago - 1, missing closes filled forward first."""
    known = bars.withColumn("__c", filled("close"))
    return known.select(*bars.columns, *[change(F.col("__c"), lag("__c", n)).alias(f"ret_{n}d") for n in horizons])


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """rsi_<n>: simple means of gains and losses over n changes; NULL without losses."""
    d = bars.withColumn("__d", F.col("close") - lag("close"))
    up, down = F.greatest("__d", F.lit(0.0)), F.greatest(-F.col("__d"), F.lit(0.0))
    gain = full(F.avg(F.when(F.col("__d").isNotNull(), up)).over(rows(n)), F.col("__d"), rows(n), n)
    loss = F.avg(F.when(F.col("__d").isNotNull(), down)).over(rows(n))
    return d.select(*bars.columns, (100 - 100 / (1 + div(gain, loss))).alias(f"rsi_{n}"))


def from_high(bars: DataFrame, n: int = YEAR, at_least: int = 63) -> DataFrame:
    """pct_from_high: close / highest close of n bars - 1, from `at_least` bars on."""
    return bars.withColumn("pct_from_high", change(F.col("close"), full(F.max("close").over(rows(n)), F.col("close"), rows(n), at_least)))


def volatility(bars: DataFrame, n: int = 21, name: str | None = None) -> DataFrame:
    """Deviation of the last n bar returns, a year's worth."""
    r = bars.withColumn("__r", change(F.col("close"), lag("close")))
    return r.select(*bars.columns, (full(F.stddev_samp("__r").over(rows(n)), F.col("__r"), rows(n), n) * sqrt(YEAR)).alias(name or f"vol_{n}d"))


def gap(bars: DataFrame) -> DataFrame:
    """gap_1d = open / close before - 1 and ret_10d."""
    return bars.select("*", change(F.col("open"), lag("close")).alias("gap_1d"), change(F.col("close"), lag("close", 10)).alias("ret_10d"))


def bar_number(bars: DataFrame) -> DataFrame:
    return bars.withColumn("bar_no", F.row_number().over(by_ticker()) - 1)


def atr(bars: DataFrame, n: int = 21) -> DataFrame:
    """atr: mean absolute close-to-close change of n bars."""
    d = bars.withColumn("__d", F.abs(F.col("close") - lag("close")))
    return d.select(*bars.columns, full(F.avg("__d").over(rows(n)), F.col("__d"), rows(n), n).alias("atr"))


def _composed(maps: DataFrame, by: list[str], order: str, most: int) -> DataFrame:
    """maps x -> a x + b, each composed with all before it of its group (of at most `most` rows), by doubling."""
    w, d = Window.partitionBy(*by).orderBy(order), 1
    while d < most:
        a, b = F.lag("a", d).over(w), F.lag("b", d).over(w)
        maps = maps.withColumns({"a": F.coalesce(F.col("a") * a, F.col("a")), "b": F.coalesce(F.col("a") * b + F.col("b"), F.col("b"))})
        d *= 2
    return maps


def wilder_atr(bars: DataFrame, n: int = 14, block_rows: int = 100_000) -> DataFrame:
    """wilder_atr: recursive mean of the true range, seeded with the first; NULL prices are left out.

    Each step is an affine map of the mean, and maps compose, so a ticker is cut into blocks of rows and those into
    chunks: running sums in chunks, maps of chunks composed in each block, maps of blocks over the ticker, then each
    chunk takes the mean it begins with. No task holds more than a block's rows and a row for each block.
    """
    q = 1 - 1 / n
    chunk = max(1, int(np.log(1e6) / -np.log(q))) if q > 0 else 1  # powers of q stay above a millionth
    parts = max(1, -(-bars.count() // block_rows))
    cut = bars.select("ticker", "date", "high", "low", "close").repartitionByRange(parts, "ticker", "date").withColumn("block", F.spark_partition_id())
    rows = stored(cut, "atr-rows")
    over_blocks, in_block = Window.partitionBy("ticker").orderBy("block"), Window.partitionBy("ticker", "block").orderBy("date")
    ends = rows.groupBy("ticker", "block").agg(F.max(F.struct("date", "close")).alias("end"))
    ends = ends.select("ticker", "block", F.lag("end.close").over(over_blocks).alias("before"))
    # the first row of a block takes the close before it from the block before
    prev = F.coalesce(F.lag("close").over(in_block), F.when(F.row_number().over(in_block) == 1, F.col("before")))
    known = rows.join(ends, ["ticker", "block"]).withColumn("prev", prev)
    spread = F.col("high") - F.col("low")
    tr = F.when(F.col("prev").isNull(), spread).otherwise(F.greatest(spread, F.abs(F.col("high") - F.col("prev")), F.abs(F.col("low") - F.col("prev"))))
    known = known.select("ticker", "date", "block", tr.alias("tr")).where("tr is not null").withColumn("k", F.row_number().over(in_block) - 1)
    known = known.select("ticker", "date", "block", "tr", F.floor(F.col("k") / chunk).cast("int").alias("chunk"), (F.col("k") % chunk).alias("j"))
    begin = known.groupBy("ticker").agg(F.min("date").alias("begin"))
    known = stored(known.join(begin, "ticker").withColumn("b", F.when(F.col("date") == F.col("begin"), F.col("tr")).otherwise(F.col("tr") / n)).drop("begin"), "atr-ranges")

    power = F.pow(F.lit(q), F.col("j")) if q > 0 else F.lit(1.0)
    run = F.sum(F.col("b") / power).over(Window.partitionBy("ticker", "block", "chunk").orderBy("j"))
    own = known.withColumn("own", power * run)
    chunks = own.groupBy("ticker", "block", "chunk").agg((F.pow(F.lit(q), F.max("j") + 1)).alias("a"), F.max_by("own", "j").alias("b"))
    chunks = stored(chunks, "atr-chunks")
    most = chunks.agg(F.max("chunk")).first()[0] or 0
    chunks = _composed(chunks, ["ticker", "block"], "chunk", most + 1)
    blocks = stored(chunks.groupBy("ticker", "block").agg(F.max_by("a", "chunk").alias("a"), F.max_by("b", "chunk").alias("b")), "atr-blocks")
    most = blocks.groupBy("ticker").count().agg(F.max("count")).first()[0] or 0
    carried = _composed(blocks, ["ticker"], "block", most).select("ticker", "block", F.lag("b").over(over_blocks).alias("into"))
    before = Window.partitionBy("ticker", "block").orderBy("chunk")
    a, b = F.lag("a").over(before), F.lag("b").over(before)
    # without a block before, the first row is the seed and nothing is carried into it
    enters = chunks.join(carried, ["ticker", "block"]).select("ticker", "block", "chunk", F.when(a.isNull(), F.coalesce("into", F.lit(0.0))).otherwise(b + a * F.coalesce("into", F.lit(0.0))).alias("enters"))
    return own.join(enters, ["ticker", "block", "chunk"]).select("ticker", "date", (F.col("own") + power * q * F.col("enters")).alias("wilder_atr"))


def frac_weights(d: float, cutoff: float = 1e-3) -> list[float]:
    """Weights of fractional differencing; the first below the cutoff is kept, then the list ends."""
    w, k = [1.0], 1
    while abs(w[-1]) >= cutoff:
        w.append(-w[-1] * (d - k + 1) / k)
        k += 1
    return w


def frac_diff(bars: DataFrame, x: str, d: float, out: str = "frac", cutoff: float = 1e-3) -> DataFrame:
    """Fixed-window fractional difference of x; rows whose window is not full or holds NULL are left out. d = 0 is identity."""
    w = frac_weights(d, cutoff) if d else [1.0]
    terms = [F.lit(v) * (lag(x, k) if k else F.col(x)) for k, v in enumerate(w) if v]
    value = terms[0]
    for t in terms[1:]:
        value = value + t
    return bars.withColumn(out, value).where(F.col(out).isNotNull())


def frac_diff_by(bars: DataFrame, x: str, d: str, out: str = "frac", cutoff: float = 1e-3) -> DataFrame:
    """frac_diff with an order for each row, a hundredth from 0 to 1 in column d: one window pass whatever the orders.

    Rows whose window is not full or holds NULL, or whose order is NULL or no such hundredth, are left out.
    """
    known = [(k, frac_weights(k / 100, cutoff) if k else [1.0]) for k in range(100)] + [(100, [1.0, -1.0])]
    weights = F.broadcast(bars.sparkSession.createDataFrame(known, "__k long, __w array<double>"))  # 101 rows
    j = bars.withColumn("__k", F.when(F.abs(F.col(d) * 100 - F.round(F.col(d) * 100)) < 1e-9, F.round(F.col(d) * 100).cast("long"))).join(weights, "__k")
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(1 - max(len(v) for _, v in known), 0)
    j = j.withColumn("__x", F.reverse(F.collect_list(F.struct(F.col(x).cast("double").alias("v"))).over(w)))  # the row's own value first
    near = F.slice("__x", F.lit(1), F.size("__w"))
    value = F.aggregate(F.zip_with(near, "__w", lambda a, b: a["v"] * b), F.lit(0.0), lambda s, t: s + t)
    return j.where(F.size("__x") >= F.size("__w")).withColumn(out, value).where(F.col(out).isNotNull()).drop("__k", "__w", "__x")


def frac_variants(rows: DataFrame, x: str, orders: Column, cutoff: float = 1e-3) -> DataFrame:
    """(ticker, date, k, frac): x differenced by each of a row's orders k, in hundredths from 0 to 100; rows whose window is not full or holds NULL are left out."""
    known = [(k, frac_weights(k / 100, cutoff) if k else [1.0]) for k in range(101)]
    weights = F.broadcast(rows.sparkSession.createDataFrame(known, "k long, __w array<double>"))  # 101 rows
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(1 - max(len(v) for _, v in known), 0)
    near = rows.withColumn("__x", F.reverse(F.collect_list(F.struct(F.col(x).cast("double").alias("v"))).over(w)))
    each = near.select("ticker", "date", "__x", F.explode(orders).alias("k")).join(weights, "k").where(F.size("__x") >= F.size("__w"))
    value = F.aggregate(F.zip_with(F.slice("__x", F.lit(1), F.size("__w")), "__w", lambda a, b: a["v"] * b), F.lit(0.0), lambda s, t: s + t)
    return each.select("ticker", "date", "k", value.alias("frac")).where("frac is not null")


def least_order(rows: DataFrame, x: str, at_most: float = 0.05) -> DataFrame:
    """(ticker, d): the least order of differencing from 0 to 1 that makes x stationary, by tenths, then by hundredths below the tenth; 1 where none does.

    Each grid is one pass: all orders of all tickers are series of the same unit-root test.
    """
    from .stats import unit_roots

    def passing(orders: Column, of: DataFrame) -> DataFrame:
        tests = unit_roots(frac_variants(of, x, orders), ["ticker", "k"], "date", "frac")
        return tests.where((F.col("p") < at_most) & (F.col("n") > 20)).groupBy(F.col("ticker").alias("t")).agg(F.min("k").alias("least"))

    of = stored(rows.select("ticker", "date", x), "series")
    names = of.select("ticker").distinct()
    coarse = stored(names.join(passing(F.sequence(F.lit(0).cast("long"), F.lit(100).cast("long"), F.lit(10).cast("long")), of), F.col("ticker") == F.col("t"), "left").select("ticker", F.col("least").alias("tenth")), "tenths")
    # the grid's begin in doubles, cut to a whole number: a tenth may begin one step lower
    begin = F.floor(F.greatest(F.col("tenth") / 100 - 0.1, F.lit(0.0)) * 100)
    finer = of.join(coarse.where("tenth > 0").withColumn("begin", begin), "ticker")
    fine = passing(F.sequence(F.col("begin"), F.col("tenth") - 1), finer)
    return coarse.join(fine, F.col("ticker") == F.col("t"), "left").select("ticker", (F.coalesce("least", "tenth", F.lit(100)) / 100).alias("d"))


def trend_regime(series: DataFrame, n: int = 63, edge: float = 0.05) -> DataFrame:
    """series (ticker, date, close) with regime bull, bear or sideways by the change over n bars; NULL while warming up."""
    c = change(F.col("close"), lag("close", n))
    return series.withColumn("trend", F.when(c > edge, "bull").when(c < -edge, "bear").when(c.isNotNull(), "sideways"))


def vol_regime(series: DataFrame, n: int = 21, edge: float = 0.20) -> DataFrame:
    v = volatility(series, n, "__v")
    return v.withColumn("vol_regime", F.when(F.col("__v") > edge, "high").when(F.col("__v").isNotNull(), "low")).drop("__v")


def calendar(bars: DataFrame) -> DataFrame:
    """Market days (date, idx). The window is over distinct days only, a few thousand a decade."""
    return bars.select("date").distinct().withColumn("idx", F.row_number().over(Window.orderBy("date")) - 1)


def lag_calendar(bars: DataFrame, x: str, n: int, out: str) -> DataFrame:
    """x of n market days before (negative n: after), NULL where the ticker has no bar that day."""
    cal = F.broadcast(calendar(bars))
    at = bars.join(cal, "date")
    other = at.select("ticker", (F.col("idx") + n).alias("idx"), F.col(x).alias(out))
    return at.join(other, ["ticker", "idx"], "left").drop("idx")


def forward_return(bars: DataFrame, horizon: int) -> DataFrame:
    """fwd: open `horizon` + 1 market days ahead over open of the next market day - 1; both opens must exist and be positive."""
    w = lag_calendar(lag_calendar(bars, "open", -1, "__o1"), "open", -(horizon + 1), "__oh")
    return w.withColumn("fwd", F.when((F.col("__o1") > 0) & (F.col("__oh") > 0), F.col("__oh") / F.col("__o1") - 1)).drop("__o1", "__oh")


def nav(returns: DataFrame) -> DataFrame:
    """series (series_id, date, ret) with nav and drawdown path, the start value 1 counted as a peak."""
    w = Window.partitionBy("series_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    n = returns.withColumn("nav", F.product(1 + F.col("ret")).over(w))
    return n.withColumn("drawdown", 1 - F.col("nav") / F.greatest(F.max("nav").over(w), F.lit(1.0)))


def period_starts(df: DataFrame, unit: str = "month") -> Column:
    """Whether a row's date begins a new month (or quarter, year) for its ticker."""
    return F.coalesce(F.date_trunc(unit, "date") != F.date_trunc(unit, lag("date")), F.lit(True))


def segments(dates: DataFrame, key: str, gap_days: int = 10) -> DataFrame:
    """Runs of dates (key, seg, start, end, n) parted where more than gap_days calendar days lie between."""
    w = Window.partitionBy(key).orderBy("date")
    cut = dates.withColumn("__new", F.when(F.datediff("date", F.lag("date").over(w)) > gap_days, 1).otherwise(0))
    seg = cut.withColumn("seg", F.sum("__new").over(w))
    return seg.groupBy(key, "seg").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("n"))
