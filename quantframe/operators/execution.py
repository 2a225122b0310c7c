"""From targets to positions: normalising, capping, backtests, reconciliation, sizing and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, COST_BPS, MAX_WEIGHT = 100_000.0, 11.0, 0.10


def normalise(targets: DataFrame) -> DataFrame:
    """targets (run, date, ticker, weight): long only, scaled down where a date's weights exceed 1."""
    w = Window.partitionBy("run", "date")
    return targets.where("weight > 0").withColumn("weight", F.col("weight") / F.greatest(F.lit(1.0), F.sum("weight").over(w)))


def cap(targets: DataFrame, most: float | None = MAX_WEIGHT) -> DataFrame:
    """No weight above `most`; what is cut stays cash."""
    return targets if most is None or most >= 1 else targets.withColumn("weight", F.least("weight", F.lit(most)))


def backtest(targets: DataFrame, bars: DataFrame, price: str = "open", cost_bps: float = COST_BPS, most: float | None = MAX_WEIGHT, start: float = START) -> DataFrame:
    """(run, date, nav, log_nav) of targets (run, date, ticker, weight), by column arithmetic: no account is replayed.

    What is decided on a bar is held from the next bar of the market on (of the run's own bars, if bars have a run), in
    each name that has a price there. A name's gain is its price over its last one and counts on the day it is known.
    With g the sum of held weights times gains, holdings drift to weight (1 + gain) / (1 + g), costs are paid on the sum of
    differences to the new weights, and nav is the running product of (1 + g) (1 - costs). A run has a row for each day on
    which it decides or holds. Shuffles are by (run, date, ticker); only days of a run are put in order.
    """
    own = [c for c in ("run",) if c in bars.columns]
    px = bars.where(F.col(price) > 0).select(*own, "date", "ticker", F.col(price).alias("p"))
    px = px.withColumn("gain", F.col("p") / F.lag("p").over(Window.partitionBy(*own, "ticker").orderBy("date")) - 1)
    days = px.select(*own, "date").distinct().withColumn("next", F.lead("date").over(Window.partitionBy(*own).orderBy("date")))  # a row a market day
    later = lambda held: held.join(days, [*own, "date"]).where("next is not null").select("run", F.col("next").alias("date"), "ticker", "weight")
    names, none = ["run", "date", "ticker"], F.lit(0.0)
    decided = cap(targets.where("weight > 0"), most).select(*names, "weight")
    held = later(decided).join(px.select(*own, "date", "ticker"), [*own, "date", "ticker"], "left_semi")
    before = later(held).join(px.select(*own, "date", "ticker", "gain"), [*own, "date", "ticker"], "left")
    rows = held.select(*names, F.col("weight").alias("new"), none.alias("old"), none.alias("gain"))
    rows = rows.unionByName(before.select(*names, none.alias("new"), F.col("weight").alias("old"), F.coalesce("gain", none).alias("gain")))
    rows = rows.unionByName(decided.join(days, [*own, "date"], "left_semi").select(*names, none.alias("new"), none.alias("old"), none.alias("gain")))
    by_name = rows.groupBy(*names).agg(*[F.sum(c).alias(c) for c in ("new", "old", "gain")])
    by_name = by_name.withColumn("g", F.sum(F.col("old") * F.col("gain")).over(Window.partitionBy("run", "date")))
    moved = F.abs(F.col("new") - F.col("old") * (1 + F.col("gain")) / (1 + F.col("g")))
    by_day = by_name.groupBy("run", "date").agg(F.log((1 + F.first("g")) * (1 - F.sum(moved) * cost_bps / 1e4)).alias("step"))
    by_day = by_day.withColumn("log_nav", F.log(F.lit(start)) + F.sum("step").over(Window.partitionBy("run").orderBy("date")))
    return by_day.select("run", "date", F.exp("log_nav").alias("nav"), "log_nav")


def nav_returns(nav: DataFrame) -> DataFrame:
    """(series_id, date, ret) of navs (run, date, log_nav); the first day of a run is left out."""
    before = F.lag("log_nav").over(Window.partitionBy("run").orderBy("date"))
    return nav.withColumn("ret", F.expm1(F.col("log_nav") - before)).where("ret is not null").select(F.col("run").alias("series_id"), "date", "ret")


def reconcile(targets: DataFrame, positions: DataFrame, prices: DataFrame, equity: float, hold: list[str] = (), least: float = 1.0) -> DataFrame:
    """Orders (symbol, qty, side) that move positions (symbol, shares) to targets (symbol, weight): whole shares, nothing under `least` of value, closing what is at or below 0.

    Symbols absent from the targets are sold unless held; names without a price are left alone.
    """
    j = targets.join(positions, "symbol", "full_outer").join(prices, "symbol", "left").withColumn("have", F.coalesce("shares", F.lit(0.0)))
    want = F.when(F.coalesce("weight", F.lit(0.0)) <= 0, F.lit(0.0)).otherwise(F.floor(F.col("weight") * equity / F.col("price")).cast("double"))
    j = j.where(~F.col("symbol").isin(list(hold))).withColumn("delta", want - F.col("have"))
    exit_all = (F.coalesce("weight", F.lit(0.0)) <= 0) & (F.col("have") > 0)
    real = exit_all | ((F.abs("delta") >= 1) & (F.abs("delta") * F.col("price") >= least))
    j = j.where(real).withColumn("qty", F.when(exit_all, F.col("have")).otherwise(F.abs("delta")))
    return j.select("symbol", "qty", F.when(F.col("delta") > 0, "buy").otherwise("sell").alias("side"))


def split_legs(orders: DataFrame, least: float = 1.0) -> DataFrame:
    """Orders (symbol, qty, side, price, fractionable) as a whole-share leg and a fractional one; a bought fraction worth less than `least` is dropped, a sold one never."""
    whole = F.floor("qty").cast("double")
    rest = F.round(F.col("qty") - whole, 9)
    keep = (rest > 0) & F.col("fractionable") & ((F.col("side") == "sell") | (rest * F.col("price") >= least))
    legs = F.array_compact(F.array(F.when(whole > 0, F.struct(whole.alias("qty"), F.lit("opg").alias("tif"))), F.when(keep, F.struct(rest.alias("qty"), F.lit("day").alias("tif")))))
    return orders.select("symbol", "side", F.explode(legs).alias("l")).select("symbol", "l.qty", "l.tif", "side")


def size(raw: str, confidence: str, kelly: float = 1.0, weight: float = 1.0, quarter: float = 0.25, most: float = 0.05):
    """Position size: a quarter of Kelly, capped; 0 for a non-positive signal or confidence under a half."""
    s = F.least(F.col(raw) * quarter * kelly * weight * F.col(confidence), F.lit(most))
    return F.when((F.col(raw) > 0) & (F.col(confidence) >= 0.5), s).otherwise(0.0)


def combine_book(sizes: DataFrame, most: float = 0.05, gross: float = 1.0) -> DataFrame:
    """(date, ticker, weight): sizes (date, signal, ticker, size) added up by name, capped, and scaled down to the gross limit."""
    named = sizes.groupBy("date", "ticker").agg(F.least(F.sum("size"), F.lit(most)).alias("s"))
    total = F.sum("s").over(Window.partitionBy("date"))
    return named.select("date", "ticker", (F.col("s") * F.least(F.lit(1.0), F.lit(gross) / F.greatest(total, F.lit(1e-12)))).alias("weight"))


def risk_latch(equity: DataFrame, max_drawdown: float = 0.15, daily: float = -0.04) -> DataFrame:
    """equity (account, date, equity, resume) with breach and halted: a breach of drawdown or day loss halts until a resume (peak and breaches then start anew)."""
    w = Window.partitionBy("account").orderBy("date")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    era = equity.withColumn("era", F.sum(F.coalesce(F.col("resume").cast("int"), F.lit(0))).over(run))
    inside = Window.partitionBy("account", "era").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    e = era.withColumn("peak", F.max("equity").over(inside)).withColumn("day", F.col("equity") / F.lag("equity").over(w) - 1)
    breach = (1 - F.col("equity") / F.col("peak") >= max_drawdown) | (F.coalesce("day", F.lit(0.0)) <= daily)
    e = e.withColumn("breach", breach & ~F.coalesce("resume", F.lit(False)))
    return e.withColumn("halted", F.max("breach").over(inside)).select("account", "date", "equity", "breach", "halted")
