"""Sinks read back and gate runs (SNK, STM06, RUN04, RUN07)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import change
from ..operators import bars as B
from ..operators import execution as X
from ..operators import labels as L
from ..operators import stats as S
from ..operators import strategies as T
from ..operators import windows as W
from ..sources import files, manifest
from ..sources.market import bars, returns, sql, table
from .registry import query
from .strategies import runs_sql

_ALL = sql("SELECT ticker, date, close, CAST(year(date) AS INTEGER) AS year FROM bars", "bars")


@query("snk01", _ALL)
def snk01(spark, d):
    """Year folders, read back."""
    path = files.work_dir(spark, "years")
    files.write_years(bars(spark, d), path)
    return spark.read.parquet(path).select("ticker", "date", "close", "year")


@query("snk02", sql("SELECT ticker, date, close FROM bars", "bars"))
def snk02(spark, d):
    """One table in canonical columns, ranges of tickers in order within files."""
    from ..operators.clean import conform

    path = files.work_dir(spark, "panel")
    conform(bars(spark, d)).repartitionByRange("ticker", "date").sortWithinPartitions("ticker", "date").write.parquet(path)
    return spark.read.parquet(path).select("ticker", "date", "close")


@query("snk03", _ALL)
def snk03(spark, d):
    """Old days written, then all days offered: only new ones are appended."""
    path, b = files.work_dir(spark, "append"), bars(spark, d)
    files.write_years(b.where("date < '2000-01-01'"), path)
    files.append_days(b, spark.read.parquet(path), path)
    return spark.read.parquet(path).select("ticker", "date", "close", "year")


@query("snk04", sql("SELECT ticker, date, close, ROUND(open / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1, 6) AS gap_1d FROM bars", "bars"))
def snk04(spark, d):
    """A column of a stored table replaced: joined on the key and committed as the table's next version."""
    path, b = files.work_dir(spark, "columns"), bars(spark, d)
    manifest.replace_table(b.withColumn("gap_1d", F.lit(None).cast("double")), path)
    new = W.gap(b).select("ticker", "date", F.round("gap_1d", 6).alias("gap_1d"))
    manifest.replace_table(manifest.read_table(spark, path).drop("gap_1d").join(new, ["ticker", "date"], "left"), path)
    return manifest.read_table(spark, path).select("ticker", "date", "close", "gap_1d")


@query("snk05", sql("SELECT ticker, date, CASE WHEN year(date) = 2001 THEN 0 ELSE close END AS close FROM bars", "bars"))
def snk05(spark, d):
    b = bars(spark, d).select("ticker", "date", "close")
    return files.merge_keep_last(b, b.where("year(date) = 2001").withColumn("close", F.lit(0.0)), ["ticker", "date"])


@query("snk07", sql("SELECT series_id, count(ret) AS n, min(date) AS first_day FROM returns GROUP BY 1", "returns"))
def snk07(spark, d):
    """A report as JSON documents, read back with its schema."""
    path = files.work_dir(spark, "report")
    returns(spark, d).groupBy("series_id").agg(F.count("ret").alias("n"), F.min("date").alias("first_day")).coalesce(1).write.json(path)
    return spark.read.schema("series_id string, n long, first_day date").json(path)


@query("snk08", "SELECT s_suppkey, s_name FROM supplier")
def snk08(spark, d):
    """Log lines appended in two batches."""
    path, s = files.work_dir(spark, "log"), table(spark, d, "supplier")
    for part in (0, 1):
        s.where(f"s_suppkey % 2 = {part}").select(F.to_json(F.struct("s_suppkey", "s_name")).alias("value")).write.mode("append").text(path)
    return spark.read.schema("s_suppkey long, s_name string").json(path)


@query("snk12", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10")
def snk12(spark, d):
    """A table replaced by rows of itself in one commit."""
    path = files.work_dir(spark, "swap")
    manifest.replace_table(table(spark, d, "nation"), path)
    manifest.replace_table(manifest.read_table(spark, path).where("n_nationkey < 10"), path)
    return manifest.read_table(spark, path).select("n_nationkey", "n_name")


@query("stm06", sql("SELECT ticker, max(date) = (SELECT max(date) FROM bars) AS fresh FROM bars GROUP BY 1", "bars"))
def stm06(spark, d):
    """Whether each ticker's last bar is of the last session."""
    last = bars(spark, d).groupBy("ticker").agg(F.max("date").alias("last"))
    top = last.agg(F.max("last").alias("top"))
    return last.crossJoin(F.broadcast(top)).select("ticker", (F.col("last") == F.col("top")).alias("fresh"))


@query(
    "run04",
    sql("", "returns", "calendar").rstrip() + runs_sql("trend")
    + f""", prev AS (SELECT b.date, b.open / p.open - 1 AS r FROM (SELECT * FROM bars JOIN calendar USING (date)) b JOIN (SELECT ticker, idx, open FROM bars JOIN calendar USING (date) WHERE open > 0) p ON p.ticker = b.ticker AND p.idx = b.idx - 1 WHERE p.open >= 5 AND b.open > 0)
    SELECT series_id, count(ret) AS n, ROUND(sum(ln(1 + ret)) * 252 / count(ret), 6) AS log_growth, ROUND(stddev_samp(ret) * sqrt(252), 6) AS vol, (SELECT ROUND(avg(m) * 252, 6) FROM (SELECT avg(r) AS m FROM prev GROUP BY date)) AS benchmark FROM rets GROUP BY 1""",
)
def run04(spark, d):
    """Gate run of the trend strategy over the whole span: navs, returns, summary."""
    b = bars(spark, d)
    f = W.volatility(b, 63, "vol").withColumn("trend", change(F.col("close"), W.lag("close", 252)))
    t = T.etf_trend(f.select("date", "ticker", "trend", "vol")).withColumn("run", F.lit("trend"))
    r = X.nav_returns(X.backtest(X.normalise(t.select("run", "date", "ticker", "weight")), b))
    g = S.growth(r).select("series_id", "n", F.round(F.log1p("cagr"), 6).alias("log_growth"), F.round("vol", 6).alias("vol"))
    return g.join(B.equal_weight_benchmark(b).agg(F.round(F.avg("ret") * 252, 6).alias("benchmark")), how="cross")


@query("run07")
def run07(spark, d):
    """Validation on ten tickers over folds of six groups."""
    b = bars(spark, d).where("cast(substr(ticker, 7) as int) <= 10")
    folds = L.runner_folds(L.cpcv(b)).select(F.concat_ws("-", "split", "seg").alias("run"), "start", "end")
    inside = lambda df: df.join(F.broadcast(folds), (F.col("date") >= F.col("start")) & (F.col("date") <= F.col("end")))
    t = X.normalise(inside(T.momentum(b)).select("run", "date", "ticker", "weight"))
    r = X.nav_returns(X.backtest(t, inside(b).select("run", "date", "ticker", "open")))
    return r.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.round(S.sharpe(), 6).alias("sharpe"))
