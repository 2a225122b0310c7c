"""Structured Streaming jobs: value bars, incremental features, keep-last, daily roll-up, sessions, and state read back.

Jobs that write do so batch by batch, each batch to a folder of its own (`batch=<id>`) that it overwrites: a batch that
runs twice changes nothing. What a job needs of earlier batches it reads from their folders, never from its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.bars import BAR_COLUMNS, value_bars
from ..operators.clean import keep_one
from ..sources.files import stored

Batch = Callable[[DataFrame, int], None]
OPEN_BARS = "ticker string, done boolean, ts timestamp, open double, high double, low double, close double, volume double, dollar_volume double, units long"


def run_available(stream: DataFrame, job: Batch, checkpoint: str, mode: str = "append") -> None:
    """All that a stream has now, through a job, then stop; the checkpoint says what the next run begins with."""
    stream.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def write_batches(folder: str) -> Batch:
    """Each batch as it comes."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def read_batches(spark: SparkSession, folder: str, schema: str, before: int | None = None) -> DataFrame:
    """Rows of all batches, or of those before one, with the column batch; no rows where none was written."""
    rows = spark.read.schema(f"{schema}, batch int").option("basePath", folder).parquet(f"{folder}/batch=*") if before is None or before > 0 else spark.createDataFrame([], f"{schema}, batch int")
    return rows if before is None else rows.where(F.col("batch") < before)


def last_written(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of rows that later batches wrote again the last."""
    return keep_one(rows, key, [F.col("batch").desc()]).drop("batch")


def bar_job(folder: str, thresholds: DataFrame, doubles: bool = False) -> Batch:
    """Value bars of a stream of ticks: complete bars go to bars/, each ticker's open bar to open/, where the next batch takes it up.

    What is kept of earlier ticks is one row a ticker; a batch's own ticks are cut into blocks as in value_bars, so a hot ticker
    lies over many tasks. Ticks of a batch are taken in time order; a batch's ticks come after those of the batches before.
    """

    def run(batch: DataFrame, number: int) -> None:
        opened = batch.sparkSession.read.schema(OPEN_BARS).parquet(f"{folder}/open/batch={number - 1}") if number else None
        rows = stored(value_bars(batch, thresholds, opened, doubles=doubles), "bars")
        rows.where("done").select(*BAR_COLUMNS).write.mode("overwrite").parquet(f"{folder}/bars/batch={number}")
        rows.where("not done").select(*[x.split()[0] for x in OPEN_BARS.split(", ")]).write.mode("overwrite").parquet(f"{folder}/open/batch={number}")

    return run


def append_job(folder: str, schema: str, history: DataFrame, features: Callable[[DataFrame], DataFrame], warm_rows: int) -> Batch:
    """Incremental append: features of new days only, with the last `warm_rows` rows of each ticker as warm-up.

    Days that are not after all of the history and of earlier batches are refused, so nothing stored changes.
    """

    def run(batch: DataFrame, number: int) -> None:
        names = batch.columns
        old = history.select(*names).unionByName(read_batches(batch.sparkSession, folder, schema, number).select(*names))
        last = old.agg(F.max("date").alias("last"))
        new = batch.crossJoin(F.broadcast(last)).where(F.col("last").isNull() | (F.col("date") > F.col("last"))).select(*names, F.lit(True).alias("new"))
        k = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("date").desc()))
        warm = old.withColumn("k", k).where(F.col("k") <= warm_rows).select(*names, F.lit(False).alias("new"))
        features(warm.unionByName(new)).where("new").drop("new").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return run


class LastOfKind(StatefulProcessor):
    """The last row (us, id) of each kind of a key, in list state: kinds are few, and a key's are read and written in one call each.

    Rows older than the watermark are left out. A kind without rows for `idle` microseconds of event time is forgotten by
    a timer; a later row begins it anew, which is right, as older ones are left out. A key asks for a timer when its first
    kind could go, and at that time for the next.
    """

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", "kind string, us long, id long")

    def _end(self, us: int) -> int:
        return (us + self.idle) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        since, got = timerValues.getCurrentWatermarkInMs() * 1000, {}
        for row in rows:
            kind, us, number = row["kind"], row["us"], row["id"]
            if us is not None and us >= since and (kind not in got or (us, number) > got[kind]):
                got[kind] = (us, number)
        known = {kind: (us, number) for kind, us, number in self.last.get()} if got else {}
        new = {kind: at for kind, at in got.items() if kind not in known or at > known[kind]}
        if new:
            self.last.put([(kind, *at) for kind, at in {**known, **new}.items()])
            first = min(us for us, _ in new.values())
            if not known or first < min(us for us, _ in known.values()):
                self.handle.registerTimer(self._end(first))
        return iter([Row(key=key[0], kind=kind, us=us, id=number) for kind, (us, number) in new.items()])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        left = [tuple(x) for x in self.last.get() if self._end(x[1]) > until]
        if left:
            self.last.put(left)
            self.handle.registerTimer(min(self._end(us) for _, us, _ in left))
        else:
            self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession):
    """State in RocksDB, which map state and timers need, for streams started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keep_last(events: DataFrame, late: str = "1 hour", idle_days: int = 30) -> DataFrame:
    """(key, kind, us, id) whenever the last row of a kind changes, from a stream (key long, kind string, ts timestamp, id long); ties in time by id. For output mode update."""
    day = 86_400_000
    rows = events.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return rows.groupBy("key").transformWithState(LastOfKind(idle_days * day * 1000), "key long, kind string, us long, id long", "Update", "EventTime")


def daily_bars(ticks: DataFrame, late: str = "1 hour") -> DataFrame:
    """Tumbling daily bars of a stream (ticker, ts, tick_id, price); ticks of days that ended before the watermark are left out by definition. For output mode update: a day is written again when it changes."""
    order = F.struct("ts", "tick_id")
    w = ticks.withWatermark("ts", late).groupBy("ticker", F.window("ts", "1 day"))
    bars = w.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count(F.lit(1)).alias("n"))
    return bars.select("ticker", F.to_date("window.start").alias("date"), "open", "high", "low", "close", "n")


def sessions(events: DataFrame, gap: str = "10 days", late: str = "30 days") -> DataFrame:
    """Runs of events (key, ts) of a stream parted by `gap` or more. For output mode append (closed runs) or complete."""
    w = events.withWatermark("ts", late).groupBy("key", F.session_window("ts", gap))
    return w.agg(F.count(F.lit(1)).alias("n")).select("key", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def held_state(positions: DataFrame) -> DataFrame:
    """Last size of each position of a stream (id, version, size): the state that a later run reads. For output mode update."""
    return positions.groupBy("id").agg(F.max_by("size", "version").alias("size"))


def saved_state(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """Keys that the aggregation of a stopped stream has in its saved state, read from its checkpoint."""
    return spark.read.format("statestore").load(checkpoint).select(F.col(f"key.{key}").alias(key))


def reconcile(saved: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """(key, action): what a run saved and the system of record still holds is kept, the rest is dropped."""
    both = saved.join(held.select(F.col(key).alias("__k"), F.lit(True).alias("__held")).distinct(), F.col(key) == F.col("__k"), "left")
    return both.select(key, F.when(F.col("__held"), "keep").otherwise("drop").alias("action"))


def upsert_keep_last(key: list[str], order: str, read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None]) -> Batch:
    """foreachBatch function that keeps the last row of each key over all batches; a batch that runs twice changes nothing."""

    def apply(batch: DataFrame, _: int) -> None:
        old = read()
        both = batch if old is None else old.unionByName(batch)
        write(keep_one(both, key, [F.col(order).desc()]))

    return apply
