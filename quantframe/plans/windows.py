"""Window and time-series queries (WIN)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import change, div, pct_rank, z_score
from ..operators import windows as W
from ..sources.market import bars, filings, macro, returns, sql
from .registry import query

T = "OVER (PARTITION BY ticker ORDER BY date)"


def frame(n: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def r6(df, *names):
    """Round the named doubles for comparison."""
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


@query("win01", sql("SELECT ticker, date, " + ", ".join(f"ROUND(close / lag(close, {n}) {T} - 1, 6) AS ret_{n}d" for n in (1, 5, 21, 63, 252)) + " FROM bars", "bars"))
def win01(spark, d):
    h = (1, 5, 21, 63, 252)
    return r6(W.lookback_returns(bars(spark, d), h), *[f"ret_{n}d" for n in h]).select("ticker", "date", *[f"ret_{n}d" for n in h])


@query(
    "win02",
    sql(
        f"""SELECT ticker, date, ROUND(CASE WHEN n = 14 THEN 100 - 100 / (1 + g / nullif(l, 0)) END, 6) AS rsi_14 FROM (
        SELECT ticker, date, count(d) {frame(14)} AS n, avg(greatest(d, 0)) {frame(14)} AS g, avg(greatest(-d, 0)) {frame(14)} AS l FROM (
        SELECT ticker, date, close - lag(close) {T} AS d FROM bars))""",
        "bars",
    ),
)
def win02(spark, d):
    return r6(W.rsi(bars(spark, d)), "rsi_14").select("ticker", "date", "rsi_14")


@query("win03", sql(f"SELECT ticker, date, ROUND(CASE WHEN count(close) {frame(252)} >= 63 THEN close / max(close) {frame(252)} - 1 END, 6) AS pct_from_high FROM bars", "bars"))
def win03(spark, d):
    return r6(W.from_high(bars(spark, d)), "pct_from_high").select("ticker", "date", "pct_from_high")


_RET = f"(SELECT *, close / lag(close) {T} - 1 AS r FROM bars)"


@query("win04", sql(f"SELECT ticker, date, ROUND(CASE WHEN count(r) {frame(21)} = 21 THEN stddev_samp(r) {frame(21)} * sqrt(252) END, 6) AS vol_21d FROM {_RET}", "bars"))
def win04(spark, d):
    return r6(W.volatility(bars(spark, d)), "vol_21d").select("ticker", "date", "vol_21d")


@query(
    "win05",
    sql(
        f"""SELECT ticker, date, ROUND(CASE WHEN n15 = 15 THEN 100 - 100 / (1 + g / nullif(l, 0)) END, 6) AS rsi_15, ROUND(v, 6) AS vol_22d, ROUND(h, 6) AS pct_from_high FROM (
        SELECT ticker, date, count(x) {frame(15)} AS n15, avg(greatest(x, 0)) {frame(15)} AS g, avg(greatest(-x, 0)) {frame(15)} AS l,
               CASE WHEN count(r) {frame(22)} = 22 THEN stddev_samp(r) {frame(22)} * sqrt(252) END AS v,
               CASE WHEN count(close) {frame(252)} >= 2 THEN close / max(close) {frame(252)} - 1 END AS h
        FROM (SELECT *, close - lag(close) {T} AS x, close / lag(close) {T} - 1 AS r FROM bars))""",
        "bars",
    ),
)
def win05(spark, d):
    """The incremental path's own definitions: 15 changes, 22 returns, 2 bars for the high."""
    b = W.volatility(W.from_high(W.rsi(bars(spark, d), 15), at_least=2), 22)
    return r6(b, "rsi_15", "vol_22d", "pct_from_high").select("ticker", "date", "rsi_15", "vol_22d", "pct_from_high")


@query("win06", sql(f"SELECT ticker, date, ROUND(open / lag(close) {T} - 1, 6) AS gap_1d, ROUND(close / lag(close, 10) {T} - 1, 6) AS ret_10d FROM bars", "bars"))
def win06(spark, d):
    return r6(W.gap(bars(spark, d)), "gap_1d", "ret_10d").select("ticker", "date", "gap_1d", "ret_10d")


_SECTOR = "CASE CAST(substr({0}, 7, 1) AS INTEGER) WHEN 1 THEN 'Brand#1' WHEN 2 THEN 'Brand#2' WHEN 3 THEN 'Brand#3' ELSE 'Brand#5' END"


@query(
    "win07",
    sql(
        f"""SELECT b.ticker, b.date, ROUND(e.r, 6) AS sector_ret_1d FROM bars b LEFT JOIN (
        SELECT ticker AS etf, date, close / lag(close) {T} - 1 AS r FROM bars WHERE ticker IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#5')) e
        ON e.etf = {_SECTOR.format("b.ticker")} AND e.date = b.date""",
        "bars",
    ),
)
def win07(spark, d):
    """A proxy instrument stands for each sector; its own bar-to-bar return is looked up by (proxy, date)."""
    b = bars(spark, d)
    etfs = b.where(F.col("ticker").isin("Brand#1", "Brand#2", "Brand#3", "Brand#5")).select(F.col("ticker").alias("etf"), "date", change(F.col("close"), W.lag("close")).alias("sector_ret_1d"))
    kind = F.substring("ticker", 7, 1)
    mapped = b.withColumn("etf", F.when(kind == "1", "Brand#1").when(kind == "2", "Brand#2").when(kind == "3", "Brand#3").otherwise("Brand#5"))
    return r6(mapped.join(etfs, ["etf", "date"], "left").select("ticker", "date", "sector_ret_1d"), "sector_ret_1d")


@query("win09", sql(f"SELECT ticker, date, row_number() {T} - 1 AS bar_no FROM bars", "bars"))
def win09(spark, d):
    return W.bar_number(bars(spark, d)).select("ticker", "date", F.col("bar_no").cast("long").alias("bar_no"))


@query("win10", sql("SELECT date, last_value(a IGNORE NULLS) OVER w AS a, last_value(b IGNORE NULLS) OVER w AS b FROM macro WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)", "macro"))
def win10(spark, d):
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row a month
    return macro(spark, d).select("date", F.last("a", True).over(w).alias("a"), F.last("b", True).over(w).alias("b"))


@query("win11", sql("SELECT ticker, filing_date, period_date, max(period_date) OVER (PARTITION BY ticker ORDER BY filing_date, period_date ROWS UNBOUNDED PRECEDING) AS newest FROM filings", "filings"))
def win11(spark, d):
    w = Window.partitionBy("ticker").orderBy("filing_date", "period_date").rowsBetween(Window.unboundedPreceding, 0)
    return filings(spark, d).select("ticker", "filing_date", "period_date", F.max("period_date").over(w).alias("newest"))


@query("win12", sql(f"SELECT ticker, date, ROUND(CASE WHEN count(d) {frame(21)} = 21 THEN avg(d) {frame(21)} END, 4) AS atr FROM (SELECT *, abs(close - lag(close) {T}) AS d FROM bars)", "bars"))
def win12(spark, d):
    return W.atr(bars(spark, d)).select("ticker", "date", F.round("atr", 4).alias("atr"))


@query(
    "win13",
    "WITH RECURSIVE " + sql("", "bars").removeprefix("WITH ").rstrip() + f""",
    tr AS (SELECT ticker, date, row_number() {T} AS k, CASE WHEN lag(close) {T} IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) {T}), abs(low - lag(close) {T})) END AS tr FROM bars),
    walk AS (SELECT ticker, date, k, tr AS a FROM tr WHERE k = 1 UNION ALL SELECT tr.ticker, tr.date, tr.k, walk.a + (tr.tr - walk.a) / 14 FROM walk JOIN tr ON tr.ticker = walk.ticker AND tr.k = walk.k + 1)
    SELECT ticker, date, ROUND(a, 4) AS wilder_atr FROM walk""",
)
def win13(spark, d):
    return W.wilder_atr(bars(spark, d)).select("ticker", "date", F.round("wilder_atr", 4).alias("wilder_atr"))


_W4 = W.frac_weights(0.8)


@query("win14", sql("SELECT ticker, date, ROUND(x, 4) AS frac FROM (SELECT ticker, date, " + " + ".join(f"({w!r}::DOUBLE) * lag(close, {k}) {T}" for k, w in enumerate(_W4)) + " AS x FROM bars) WHERE x IS NOT NULL", "bars"))
def win14(spark, d):
    return W.frac_diff(bars(spark, d), "close", 0.8).select("ticker", "date", F.round("frac", 4).alias("frac"))


_MKT = "mkt AS (SELECT 'market' AS ticker, date, avg(close) AS close FROM bars GROUP BY date)"


def market(spark, d):
    return bars(spark, d).groupBy("date").agg(F.avg("close").alias("close")).withColumn("ticker", F.lit("market"))


@query(
    "win17",
    sql("", "bars").rstrip() + f", {_MKT} SELECT date, CASE WHEN c > 0.05 THEN 'bull' WHEN c < -0.05 THEN 'bear' WHEN c IS NOT NULL THEN 'sideways' END AS trend FROM (SELECT date, close / lag(close, 63) {T} - 1 AS c FROM mkt)",
)
def win17(spark, d):
    return W.trend_regime(market(spark, d)).select("date", "trend")


@query(
    "win18",
    sql("", "bars").rstrip()
    + f", {_MKT} SELECT date, CASE WHEN v > 8 THEN 'high' WHEN v IS NOT NULL THEN 'low' END AS vol_regime FROM (SELECT date, CASE WHEN count(r) {frame(21)} = 21 THEN stddev_samp(r) {frame(21)} * sqrt(252) END AS v FROM (SELECT *, close / lag(close) {T} - 1 AS r FROM mkt))",
)
def win18(spark, d):
    return W.vol_regime(market(spark, d), edge=8.0).select("date", "vol_regime")


@query("win19", sql(f"SELECT ticker, date, ROUND(close / lag(close, 252) {T} - 1, 6) AS trend, ROUND(CASE WHEN count(r) {frame(63)} = 63 THEN stddev_samp(r) {frame(63)} * sqrt(252) END, 6) AS vol FROM {_RET}", "bars"))
def win19(spark, d):
    b = W.volatility(bars(spark, d), 63, "vol").withColumn("trend", change(F.col("close"), W.lag("close", 252)))
    return r6(b.select("ticker", "date", "trend", "vol"), "trend", "vol")


@query(
    "win20",
    sql(
        """SELECT b.ticker, b.date, ROUND(CASE WHEN o1.open > 0 AND oh.open > 0 THEN oh.open / o1.open - 1 END, 6) AS fwd
        FROM bars b JOIN calendar c USING (date)
        LEFT JOIN (SELECT ticker, idx, open FROM bars JOIN calendar USING (date)) o1 ON o1.ticker = b.ticker AND o1.idx = c.idx + 1
        LEFT JOIN (SELECT ticker, idx, open FROM bars JOIN calendar USING (date)) oh ON oh.ticker = b.ticker AND oh.idx = c.idx + 6""",
        "bars", "calendar",
    ),
)
def win20(spark, d):
    return r6(W.forward_return(bars(spark, d), 5), "fwd").select("ticker", "date", "fwd")


_NAV = "(SELECT series_id, date, exp(sum(ln(1 + ret)) OVER w) AS nav FROM returns WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING))"


@query("win22", sql(f"SELECT series_id, date, ROUND(ln(nav), 5) AS log_nav, ROUND(1 - nav / greatest(max(nav) OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING), 1), 6) AS drawdown FROM {_NAV}", "returns"))
def win22(spark, d):
    return W.nav(returns(spark, d)).select("series_id", "date", F.round(F.log("nav"), 5).alias("log_nav"), F.round("drawdown", 6).alias("drawdown"))


@query("win23", sql(f"SELECT series_id, date, ROUND(r, 6) AS ret FROM (SELECT series_id, date, nav / lag(nav) OVER (PARTITION BY series_id ORDER BY date) - 1 AS r FROM {_NAV}) WHERE r IS NOT NULL", "returns"))
def win23(spark, d):
    w = Window.partitionBy("series_id").orderBy("date")
    n = W.nav(returns(spark, d)).withColumn("ret", change(F.col("nav"), F.lag("nav").over(w)))
    return n.where("ret is not null").select("series_id", "date", F.round("ret", 6).alias("ret"))


@query("win24", sql(f"SELECT ticker, date, lag(close) {T} AS prev_close, lag(date) {T} AS prev_date FROM bars", "bars"))
def win24(spark, d):
    return bars(spark, d).select("ticker", "date", W.lag("close").alias("prev_close"), W.lag("date").alias("prev_date"))


@query(
    "win25",
    sql(
        "SELECT ticker, period_date, ROUND((roe - p) / nullif(abs(p), 0), 6) AS yoy FROM (SELECT ticker, period_date, roe, lag(roe) OVER (PARTITION BY ticker, quarter(period_date) ORDER BY period_date) AS p FROM (SELECT DISTINCT ticker, period_date, roe FROM filings))",
        "filings",
    ),
)
def win25(spark, d):
    f = filings(spark, d).select("ticker", "period_date", "roe").distinct()
    p = F.lag("roe").over(Window.partitionBy("ticker", F.quarter("period_date")).orderBy("period_date"))
    return f.withColumn("p", p).select("ticker", "period_date", F.round(div(F.col("roe") - F.col("p"), F.abs("p")), 6).alias("yoy"))


@query(
    "win26",
    sql(
        "SELECT ticker, period_date, ROUND((roe - p) / nullif(abs(p), 0), 6) AS revision FROM (SELECT ticker, period_date, roe, lag(roe) OVER (PARTITION BY ticker ORDER BY period_date) AS p FROM (SELECT DISTINCT ticker, period_date, roe FROM filings))",
        "filings",
    ),
)
def win26(spark, d):
    f = filings(spark, d).select("ticker", "period_date", "roe").distinct()
    p = F.lag("roe").over(Window.partitionBy("ticker").orderBy("period_date"))
    return f.withColumn("p", p).select("ticker", "period_date", F.round(div(F.col("roe") - F.col("p"), F.abs("p")), 6).alias("revision"))


def _rank_sql(by: str, x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / CAST(count({x}) OVER (PARTITION BY {by}) AS DOUBLE) END"


@query("win27", sql(f"SELECT ticker, date, ROUND(coalesce({_rank_sql('date', 'r')}, 0.5), 6) AS r_rank, ROUND({_rank_sql('date', 'volume')}, 6) AS volume_rank FROM {_RET}", "bars"))
def win27(spark, d):
    b = bars(spark, d).withColumn("r", change(F.col("close"), W.lag("close")))
    return b.select("ticker", "date", F.round(F.coalesce(pct_rank("r", ["date"]), F.lit(0.5)), 6).alias("r_rank"), F.round(pct_rank("volume", ["date"]), 6).alias("volume_rank"))


@query("win28", sql(f"SELECT ticker, date, ROUND({_rank_sql('q', 'volume')} - 0.5, 6) AS volume_rank FROM (SELECT *, date_trunc('quarter', date) AS q FROM bars)", "bars"))
def win28(spark, d):
    b = bars(spark, d).withColumn("q", F.date_trunc("quarter", "date"))
    return b.select("ticker", "date", F.round(pct_rank("volume", ["q"]) - 0.5, 6).alias("volume_rank"))


@query("win29", sql("SELECT ticker, date, ROUND(coalesce((volume - avg(volume) OVER w) / nullif(stddev_pop(volume) OVER w, 0), 0), 5) AS z FROM bars WINDOW w AS (PARTITION BY date)", "bars"))
def win29(spark, d):
    return bars(spark, d).select("ticker", "date", F.round(z_score("volume", ["date"]), 5).alias("z"))


@query("win30", sql("SELECT date, ROUND(b, 8) AS b, ROUND(b_lag, 8) AS b_lag FROM (SELECT date, b, lag(b) OVER (ORDER BY date) AS b_lag FROM book) WHERE b_lag IS NOT NULL", "book"))
def win30(spark, d):
    book = returns(spark, d).groupBy("date").agg(F.avg("ret").alias("b"))
    lagged = book.withColumn("b_lag", F.lag("b").over(Window.orderBy("date")))  # one row a market day
    return lagged.where("b_lag is not null").select("date", F.round("b", 8).alias("b"), F.round("b_lag", 8).alias("b_lag"))


@query(
    "win31",
    sql(
        f"""SELECT ticker, CAST(seg AS BIGINT) AS seg, min(date) AS "start", max(date) AS "end", count(*) AS n FROM (
        SELECT ticker, date, sum(CASE WHEN g > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY date) AS seg FROM (
        SELECT ticker, date, date - lag(date) {T} AS g FROM bars)) GROUP BY 1, 2""",
        "bars",
    ),
)
def win31(spark, d):
    return W.segments(bars(spark, d).select("ticker", "date"), "ticker")


@query("win32", sql(f"SELECT ticker, date, coalesce(date_trunc('month', date) <> date_trunc('month', lag(date) {T}), true) AS new_month, coalesce(date_trunc('quarter', date) <> date_trunc('quarter', lag(date) {T}), true) AS new_quarter FROM bars", "bars"))
def win32(spark, d):
    b = bars(spark, d)
    return b.select("ticker", "date", W.period_starts(b, "month").alias("new_month"), W.period_starts(b, "quarter").alias("new_quarter"))


@query("win33", sql("SELECT ticker, date FROM (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars) WHERE k <= 70", "bars"))
def win33(spark, d):
    k = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("date").desc()))
    return bars(spark, d).withColumn("k", k).where("k <= 70").select("ticker", "date")


@query("win34", sql("SELECT ticker, date FROM bars JOIN calendar USING (date) WHERE idx % 5 = 0", "bars", "calendar"))
def win34(spark, d):
    b = bars(spark, d)
    return b.join(F.broadcast(W.calendar(b).where("idx % 5 = 0")), "date").select("ticker", "date")
