"""Strategies as target weights (date, ticker, weight). Set-based where rules need no path; a per-ticker or per-day fold where they do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import change, div, z_score
from . import chains
from . import windows as W
from .clean import top_quantile
from .joins import asof

# fixed values: words of the transcript score and what is stripped from a word
POSITIVE = (
    "beat exceeded record strong growth increased improved expanding raised robust solid confident optimistic "
    "outperformed delivered achieved momentum accelerating attractive exceptional favorable strength"
).split()
NEGATIVE = (
    "declined decreased loss below missed challenged difficult concern risk weak disappointing unfavorable "
    "reduced cut falling headwind impairment restructuring downturn adverse deteriorated underperformed"
).split()
UNCERTAIN = (
    "may might could approximately potentially uncertain estimates expects anticipates projected depends pending subject "
    "likely possible if perhaps sometime whether"
).split()
STRIP = ".,;:!?\"'()"


def carry(targets: DataFrame, days: DataFrame, bars: DataFrame) -> DataFrame:
    """Targets of a decision date held on every later day until the next, for names with a bar that day."""
    decided = targets.select("date").distinct().withColumn("k", F.lit(1)).select("k", F.col("date").alias("decided"))
    at = asof(days.withColumn("k", F.lit(1)), decided, ["k"], "date", "decided", ["decided"]).where("decided is not null").drop("k")
    held = at.join(targets.withColumnRenamed("date", "decided"), "decided")
    return held.join(bars.select("date", "ticker"), ["date", "ticker"], "left_semi").select("date", "ticker", "weight")


def momentum(bars: DataFrame, skip: int = 20, back: int = 272) -> DataFrame:
    """12-1 momentum: on the first market day of a month the top fifth by close `skip` bars ago over `back` bars ago, equal weight, held between."""
    days = bars.select("date").distinct()
    first = days.groupBy(F.trunc("date", "month").alias("m")).agg(F.min("date").alias("date")).select("date")
    score = bars.withColumn("mom", change(W.lag("close", skip), W.lag("close", back)))
    picked = top_quantile(score.join(F.broadcast(first), "date"), "mom", ["date"])
    return carry(picked.select("date", "ticker", "weight"), days, bars)


def quality(facts: DataFrame, bars: DataFrame, lag_days: int = 45) -> DataFrame:
    """z(roe) - z(leverage) + z(margin) by quarter, top fifth equal weight, in force `lag_days` after the quarter's end."""
    q = facts.withColumn("score", z_score("roe", ["period_date"]) - z_score("lev", ["period_date"]) + z_score("margin", ["period_date"]))
    top = top_quantile(q, "score", ["period_date"]).select(F.date_add("period_date", lag_days).alias("date"), "ticker", "weight")
    return carry(top, bars.select("date").distinct(), bars)


def etf_trend(features: DataFrame) -> DataFrame:
    """Inverse-volatility weights over all names with features (date, ticker, trend, vol); names without an uptrend hold cash."""
    f = features.dropna(subset=["trend", "vol"]).where("vol > 0")
    inv = 1 / F.col("vol")
    return f.withColumn("weight", inv / F.sum(inv).over(Window.partitionBy("date"))).withColumn("weight", F.when(F.col("trend") > 0, F.col("weight")).otherwise(0.0)).select("date", "ticker", "weight")


def transcript_score(text: Column, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE, uncertain: list[str] = UNCERTAIN) -> Column:
    """(positive - negative) / words - half the uncertain share; 0 for empty text."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    clean = F.transform(words, lambda w: F.btrim(w, F.lit(STRIP)))
    count = lambda lexicon: F.size(F.filter(clean, lambda w: w.isin(*lexicon)))
    n = F.size(words)
    return F.when(n > 0, (count(positive) - count(negative)) / n - 0.5 * count(uncertain) / n).otherwise(0.0)


def hold_entries(entries: DataFrame, hold: int, size: float = 0.02, block_rows: int = chains.BLOCK_ROWS) -> DataFrame:
    """Rows (date, ticker, entry) in force: an entry while none is held gives `size` for `hold` bars, then 0 once.

    Which entries are taken is a chain over bar numbers, so a ticker's bars lie over many tasks.
    """
    rows = entries.select("ticker", "date", "entry")
    rows = chains.chain(rows, "ticker", ["date"], F.lit(1), F.lit(hold + 1), F.lit(0), F.coalesce("entry", F.lit(False)), block_rows)
    bars_in = F.when(F.col("chosen"), 0).otherwise(F.col("total") - F.col("need") + hold + 1)
    held = rows.withColumn("since", bars_in).where(F.col("chosen") | (F.col("since") <= hold))
    return held.select("date", "ticker", F.when(F.col("chosen") | (F.col("since") < hold), size).otherwise(0.0).alias("weight"))


def surprise_entries(panel: DataFrame, eps: float = 0.05, gap: float = 0.03, runup: float = 0.10, sector: float = -0.015) -> DataFrame:
    """panel with entry: a reaction bar with enough surprise, growing revenue and a gap up, without a run-up before it or a weak sector; what is not known is no entry."""
    before = div(1 + F.col("ret_10d"), 1 + F.col("ret_1d")) - 1
    rules = (F.col("days_since") == 0) & (F.col("surprise") >= eps) & (F.col("revenue_surprise") > 0) & (F.col("gap_1d") >= gap) & (before <= runup) & (F.col("sector_ret_1d") > sector)
    return panel.withColumn("entry", F.coalesce(rules, F.lit(False)))
