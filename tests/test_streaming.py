"""Streams give what the batch operators give."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql import functions as F

from quantframe.operators import bars as B
from quantframe.operators import windows as W
from quantframe.streaming import stateful as S

TICKS = "ticker string, ts timestamp, price double, size double"


def arrive(spark, parts, folder, start, job, mode="append"):
    """A run over each part after it is written."""
    for k, part in enumerate(parts):
        part.write.parquet(f"{folder}/in/part={k}")
        live = spark.readStream.schema(part.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        S.run_available(start(live), job, f"{folder}/checkpoint", mode)


def test_value_bars_of_three_runs_equal_the_batch(spark, tmp_path):
    rows = [(t, datetime(2023, 1, 1) + timedelta(minutes=k), 100.0 + k % 7, float(10 + k % 40)) for t in "AB" for k in range(300)] + [("C", datetime(2023, 1, 1), 5.0, 1.0)]
    ticks = spark.createDataFrame(rows, TICKS)
    limits = ticks.select("ticker").distinct().selectExpr("ticker", "20000.0D as threshold")
    parts = [ticks.where(f"minute(ts) + 60 * hour(ts) between {a} and {b}") for a, b in ((0, 99), (100, 199), (200, 299))]
    job = S.bar_job(f"{tmp_path}/out", limits)
    arrive(spark, parts, tmp_path, lambda s: s, job)
    kinds = "ticker string, ts timestamp, open double, high double, low double, close double, volume double, dollar_volume double"
    read = lambda: sorted(map(tuple, S.read_batches(spark, f"{tmp_path}/out/bars", kinds).drop("batch").collect()))
    want = sorted(map(tuple, B.dollar_bars(ticks, limits).collect()))
    assert read() == want and want
    job(parts[2], 2)  # a batch that runs twice changes nothing
    assert read() == want
    left = S.read_batches(spark, f"{tmp_path}/out/open", S.OPEN_BARS).where("batch = 2").collect()
    assert {r.ticker for r in left} == {"A", "B", "C"} and not any(r.done for r in left)


def test_value_bars_of_a_stream_end_where_a_loop_over_doubles_ends_them(spark, tmp_path):
    rows = [(t, datetime(2023, 1, 1) + timedelta(minutes=k), 0.1 * n, 1.0) for n, t in ((1, "A"), (3, "B")) for k in range(125)]
    ticks = spark.createDataFrame(rows, TICKS)
    limits = spark.createDataFrame([("A", 1.0), ("B", 3.0)], "ticker string, threshold double")
    minute = F.expr("minute(ts) + 60 * hour(ts)")
    # A's first ten ticks reach 1 in tenths, not in doubles: its bar is open after the first part
    parts = [ticks.where(minute < 10), ticks.where((minute >= 10) & (minute < 64)), ticks.where(minute >= 64)]
    arrive(spark, parts, tmp_path, lambda s: s, S.bar_job(f"{tmp_path}/out", limits, doubles=True))
    want, now = [], {}
    for t, ts, price, _ in rows:
        begin, n, total = now.pop(t, (ts, 0, 0.0))
        now[t] = (begin, n + 1, total + price)
        if now[t][2] >= {"A": 1.0, "B": 3.0}[t]:
            want.append((t, *now.pop(t)[:2]))
    kinds = "ticker string, ts timestamp, open double, high double, low double, close double, volume double, dollar_volume double"
    assert sorted((r.ticker, r.ts, r.volume) for r in S.read_batches(spark, f"{tmp_path}/out/bars", kinds).collect()) == sorted(want)
    assert want[0][2] == 11


def test_incremental_features_equal_the_batch(spark, tmp_path):
    rows = [(t, date(2020, 1, 1) + timedelta(k), 100.0 + (k * 7 + n) % 11) for n, t in enumerate("AB") for k in range(60)]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double")
    features = lambda b: W.lookback_returns(b, (5,))
    job = S.append_job(f"{tmp_path}/out", "ticker string, date date, close double, ret_5d double", bars.where("date < '2020-01-20'"), features, 10)
    parts = [bars.where("date between '2020-01-20' and '2020-01-31'"), bars.where("date between '2020-01-25' and '2020-02-10'"), bars.where("date > '2020-02-10'")]
    arrive(spark, parts, tmp_path, lambda s: s, job)
    read = lambda: sorted((r.ticker, r.date, r.ret_5d) for r in S.read_batches(spark, f"{tmp_path}/out", "ticker string, date date, close double, ret_5d double").collect())
    want = sorted((r.ticker, r.date, r.ret_5d) for r in features(bars).where("date >= '2020-01-20'").collect())
    assert read() == want
    job(parts[1], 1)
    assert read() == want


def test_last_rows_and_late_rows(spark, tmp_path):
    at = lambda hour: datetime(2023, 1, 1) + timedelta(hours=hour)
    schema = "key long, kind string, ts timestamp, id long"
    parts = [[(1, "a", at(0), 1), (1, "b", at(1), 2), (2, "a", at(9), 3)], [(1, "a", at(10), 5), (1, "a", at(10), 4), (2, "a", at(8), 9)], [(1, "b", at(2), 7), (2, "a", at(11), 8)]]
    with S.rocks(spark):
        arrive(spark, [spark.createDataFrame(p, schema) for p in parts], tmp_path, lambda s: S.keep_last(s, late="2 hours"), S.write_batches(f"{tmp_path}/out"), "update")
    out = S.last_written(S.read_batches(spark, f"{tmp_path}/out", "key long, kind string, us long, id long"), ["key", "kind"])
    # (1, b, 2 o'clock) came when the watermark was past it, (2, a, 8 o'clock) was older than what is kept
    assert sorted((r.key, r.kind, r.id) for r in out.collect()) == [(1, "a", 5), (1, "b", 2), (2, "a", 8)]


def test_idle_kinds_are_forgotten(spark, tmp_path):
    at = lambda day: datetime(2023, 1, 1) + timedelta(days=day)
    schema = "key long, kind string, ts timestamp, id long"
    parts = [[(1, "a", at(0), 1), (1, "b", at(9), 2)], [(2, "a", at(20), 3)], [(2, "a", at(21), 4)]]
    with S.rocks(spark):
        arrive(spark, [spark.createDataFrame(p, schema) for p in parts], tmp_path, lambda s: S.keep_last(s, idle_days=5), S.write_batches(f"{tmp_path}/out"), "update")
        kept = spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/checkpoint")
        assert {(r.key.key, r.user_map_key.kind if "user_map_key" in r else None) for r in kept.collect()} <= {(2, "a"), (2, None)}


def test_a_key_is_read_and_written_in_one_call_each():
    calls = []

    class State:
        held = []

        def get(self):
            calls.append("get")
            return iter(self.held)

        def put(self, rows):
            calls.append("put")
            self.held = rows

    state = State()
    last = S.LastOfKind(1000)
    last.init(SimpleNamespace(getListState=lambda *_: state, registerTimer=lambda at: calls.append("timer")))
    rows = [Row(key=1, kind=f"k{n % 50}", us=5000 + n, id=n) for n in range(500)]
    out = [r for part in (rows[:250], rows[250:]) for r in last.handleInputRows((1,), iter(part), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0))]
    assert calls == ["get", "put", "timer", "get", "put"] and len(out) == 100
    assert sorted(state.held) == sorted((f"k{n % 50}", 5000 + n, n) for n in range(450, 500))


def test_daily_bars_are_written_again_when_they_change(spark, tmp_path):
    rows = [("A", datetime(2023, 1, 1 + k // 24, k % 24), k, 100.0 + k % 5) for k in range(72)]
    ticks = spark.createDataFrame(rows, "ticker string, ts timestamp, tick_id long, price double")
    parts = [ticks.where("tick_id < 30"), ticks.where("tick_id between 30 and 50"), ticks.where("tick_id > 50")]
    arrive(spark, parts, tmp_path, S.daily_bars, S.write_batches(f"{tmp_path}/out"), "update")
    kinds = "ticker string, date date, open double, high double, low double, close double, n long"
    out = S.last_written(S.read_batches(spark, f"{tmp_path}/out", kinds), ["ticker", "date"])
    assert sorted((r.date.day, r.open, r.close, r.n) for r in out.collect()) == [(1, 100.0, 103.0, 24), (2, 104.0, 102.0, 24), (3, 103.0, 101.0, 24)]


def test_sessions_close(spark, tmp_path):
    at = lambda day: datetime(2023, 1, 1) + timedelta(days=day)
    rows = [[("A", at(0)), ("A", at(3))], [("A", at(20)), ("B", at(21))]]
    arrive(spark, [spark.createDataFrame(p, "key string, ts timestamp") for p in rows], tmp_path, S.sessions, S.write_batches(f"{tmp_path}/out"), "complete")
    out = S.read_batches(spark, f"{tmp_path}/out", "key string, start timestamp, end timestamp, n long")
    last = out.agg(F.max("batch")).first()[0]
    assert sorted((r.key, r.start, r.n) for r in out.where(f"batch = {last}").collect()) == [("A", at(0), 2), ("A", at(20), 1), ("B", at(21), 1)]


def test_a_second_run_reads_what_the_first_left(spark, tmp_path):
    rows = [(k, 1, float(k)) for k in range(6)]
    arrive(spark, [spark.createDataFrame(rows[:3], "id long, version long, size double"), spark.createDataFrame(rows[3:], "id long, version long, size double")], tmp_path, S.held_state, S.write_batches(f"{tmp_path}/out"), "update")
    saved = S.saved_state(spark, f"{tmp_path}/checkpoint", "id")
    assert sorted(r.id for r in saved.collect()) == list(range(6))
    held = spark.createDataFrame([(1,), (1,), (4,), (9,)], "id long")
    assert dict(map(tuple, S.reconcile(saved, held, "id").collect())) == {0: "drop", 1: "keep", 2: "drop", 3: "drop", 4: "keep", 5: "drop"}


def test_upsert_is_idempotent(spark):
    held = {}
    f = S.upsert_keep_last(["k"], "v", lambda: held.get("t"), lambda df: held.update(t=spark.createDataFrame(df.collect(), df.schema)))
    a = spark.createDataFrame([(1, 1), (1, 2), (2, 5)], "k int, v int")
    for batch in (a, a, spark.createDataFrame([(2, 4), (3, 1)], "k int, v int")):
        f(batch, 0)
    assert sorted(map(tuple, held["t"].collect())) == [(1, 2), (2, 5), (3, 1)]
