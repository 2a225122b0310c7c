"""Streams (STM02 to STM05, STM07, STM10): each runs several times over input that arrives in parts, with one checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import windows as W
from ..sources import files
from ..sources.market import bars, sql, table, ticks
from ..streaming import stateful as S
from .aggregates import TICK_BARS
from .registry import query


def _runs(parts: list[DataFrame], start: Callable[[DataFrame], DataFrame], job: S.Batch, mode: str = "append") -> str:
    """A run for each part of the input, which is written before it; the folder of the checkpoint."""
    spark, schema = parts[0].sparkSession, parts[0].schema
    folder, checkpoint = files.work_dir(spark, "arriving"), files.work_dir(spark, "checkpoint")
    for k, part in enumerate(parts):
        part.write.parquet(f"{folder}/part={k}")
        S.run_available(start(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)), job, checkpoint, mode)
    return checkpoint


def _thirds(rows: DataFrame, by: str) -> list[DataFrame]:
    """rows in three parts by time."""
    first, last = rows.agg(F.min(F.col(by).cast("timestamp")), F.max(F.col(by).cast("timestamp"))).first()
    cuts = [first + (last - first) * k / 3 for k in (1, 2)]
    at, (a, b) = F.col(by).cast("timestamp"), [F.lit(x) for x in cuts]
    return [rows.where(at < a), rows.where((at >= a) & (at < b)), rows.where(at >= b)]


@query("stm02", sql("SELECT ticker, date, ROUND(close / lag(close, 5) OVER (PARTITION BY ticker ORDER BY date) - 1, 6) AS ret_5d FROM bars QUALIFY date > DATE '2001-06-30'", "bars"))
def stm02(spark, d):
    """Incremental append: new days arrive in three runs, one of them with old days too; features are computed with the bars before them as warm-up."""
    b = files.stored(bars(spark, d), "bars")
    history, new = b.where("date <= '2001-06-30'"), b.where("date > '2001-06-30'")
    parts = [new.where("date <= '2001-08-31'"), b.where("date between '2001-06-01' and '2001-10-31'"), new.where("date > '2001-10-31'")]
    folder, schema = files.work_dir(spark, "features"), ", ".join(f"{n} {t}" for n, t in b.dtypes)
    features = lambda rows: W.lookback_returns(rows, (5,))
    _runs(parts, lambda s: s, S.append_job(folder, f"{schema}, ret_5d double", history, features, 70))
    out = S.read_batches(spark, folder, f"{schema}, ret_5d double")
    return out.select("ticker", "date", F.round("ret_5d", 6).alias("ret_5d"))


@query("stm03", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def stm03(spark, d):
    """Keep-last of each user's event types as a stream with list state, timers and time to live."""
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))
    folder = files.work_dir(spark, "last")
    with S.rocks(spark):
        _runs(_thirds(e, "ts"), S.keep_last, S.write_batches(folder), "update")
    out = S.last_written(S.read_batches(spark, folder, "key long, kind string, us long, id long"), ["key", "kind"])
    return out.select(F.col("key").alias("user_id"), F.col("kind").alias("event_type"), F.col("id").alias("event_id"))


@query("stm04", TICK_BARS)
def stm04(spark, d):
    """Value-driven bars of a stream: the same bars as over all ticks at once."""
    t = ticks(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    limit = files.stored(t.select("ticker").distinct().withColumn("threshold", F.lit(2000.0)), "thresholds")
    folder = files.work_dir(spark, "value-bars")
    _runs(_thirds(t, "ts"), lambda s: s, S.bar_job(folder, limit, doubles=True))
    kinds = "ticker string, ts timestamp, open double, high double, low double, close double, volume double, dollar_volume double"
    return S.read_batches(spark, f"{folder}/bars", kinds).drop("batch").withColumn("dollar_volume", F.round("dollar_volume", 4))


@query(
    "stm05",
    sql(
        """SELECT ticker, min(date) AS "start", count(*) AS n FROM (SELECT ticker, date, sum(CASE WHEN g > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY date) AS seg FROM (SELECT ticker, date, date - lag(date) OVER (PARTITION BY ticker ORDER BY date) AS g FROM bars)) GROUP BY ticker, seg""",
        "bars",
    ),
)
def stm05(spark, d):
    """Contiguous runs as session windows of a stream; the last run's result holds all of them."""
    b = bars(spark, d).select(F.col("ticker").alias("key"), F.col("date").cast("timestamp").alias("ts"))
    folder = files.work_dir(spark, "sessions")
    _runs(_thirds(files.stored(b, "days"), "ts"), S.sessions, S.write_batches(folder), "complete")
    rows = S.read_batches(spark, folder, "key string, start timestamp, end timestamp, n long")
    last = rows.agg(F.max("batch").alias("last"))
    return rows.join(F.broadcast(last), F.col("batch") == F.col("last")).select(F.col("key").alias("ticker"), F.to_date("start").alias("start"), "n")


@query("stm07", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'drop' ELSE 'keep' END AS action FROM supplier WHERE s_suppkey % 2 = 0")
def stm07(spark, d):
    """State kept between runs: one run leaves positions in its operator's state, a later one reads them and drops what is no longer held."""
    s = table(spark, d, "supplier")
    opened = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), F.lit(1).cast("long").alias("version"), F.col("s_acctbal").alias("size"))
    parts = [opened.where("id % 5 > 0"), opened.where("id % 5 = 0")]
    checkpoint = _runs(parts, S.held_state, S.write_batches(files.work_dir(spark, "positions")), "update")
    held = s.where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("id"))
    return S.reconcile(S.saved_state(spark, checkpoint, "id"), held, "id")


@query("stm10", "SELECT event_type AS ticker, CAST(ts AS DATE) AS date, first(value ORDER BY ts) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts) AS close, count(*) AS n FROM events GROUP BY 1, 2")
def stm10(spark, d):
    """Daily bars of a stream of ticks; a day that two runs share is written by both, and the later one counts."""
    t = ticks(spark, d).select("ticker", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tick_id"), "price")
    folder = files.work_dir(spark, "daily")
    _runs(_thirds(t, "ts"), S.daily_bars, S.write_batches(folder), "update")
    kinds = "ticker string, date date, open double, high double, low double, close double, n long"
    return S.last_written(S.read_batches(spark, folder, kinds), ["ticker", "date"])
