"""Operators cut into blocks against plain folds over the rows in order."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantframe.operators import bars as B
from quantframe.operators import chains
from quantframe.operators import stats as S
from quantframe.operators import strategies as T
from quantframe.operators import windows as W

TICKS = "ticker string, ts timestamp, price double, size double"


def fold_bars(rows, threshold):
    """Bars by a walk over the ticks, in cents; the open bar last."""
    done, now = [], None
    for _, ts, price, size in sorted(rows, key=lambda r: r[1:]):
        v = round(price * size * 1e4)
        now = (ts, price, price, price, price, size, v) if now is None else (now[0], now[1], max(now[2], price), min(now[3], price), price, now[5] + size, now[6] + v)
        if now[6] >= round(threshold * 1e4):
            done.append(now)
            now = None
    return done, now


def ticks_of(rng, ticker, n, zero=0.1):
    begin = datetime(2023, 1, 1)
    return [(ticker, begin + timedelta(seconds=k // 3), round(rng.uniform(1, 9), 2), 0.0 if rng.random() < zero else float(rng.randint(1, 9))) for k in range(n)]


def seen(bars):
    return [(b[0], b[1], b[2], b[3], b[4], round(b[5], 6), round(b[6] / 1e4, 6)) for b in bars]


@pytest.mark.parametrize(("threshold", "block_rows"), [(60.0, 37), (1500.0, 20), (5.0, 100_000), (1e9, 30)])
def test_bars_equal_the_fold(spark, threshold, block_rows):
    rng = random.Random(threshold)
    rows = ticks_of(rng, "A", 700) + ticks_of(rng, "B", 90) + ticks_of(rng, "C", 1) + [("A", datetime(2023, 1, 1), None, 1.0)]
    limits = spark.createDataFrame([(x, threshold) for x in "ABC"], "ticker string, threshold double")
    got = B.value_bars(spark.createDataFrame(rows, TICKS), limits, block_rows=block_rows).collect()
    for t in "ABC":
        done, last = fold_bars([r for r in rows if r[0] == t and r[2] is not None], threshold)
        mine = sorted((r for r in got if r.ticker == t), key=lambda r: (r.ts, not r.done))
        plain = lambda r: (r.ts, r.open, r.high, r.low, r.close, round(r.volume, 6), round(r.units / 1e4, 6))
        assert sorted(plain(r) for r in mine if r.done) == sorted(seen(done))
        assert [plain(r) for r in mine if not r.done] == (seen([last]) if last else [])


def loop_bars(rows, threshold):
    """(ticker, ts, ticks, value) of the bars that a loop over doubles finds; the open ones last."""
    done, now = [], {}
    for t, ts, price, size in sorted(rows):
        begin, n, total = now.pop(t, (ts, 0, 0.0))
        now[t] = (begin, n + 1, total + price * size)
        if now[t][2] >= threshold:
            done.append((t, *now.pop(t)))
    return sorted(done), sorted((t, *v) for t, v in now.items())


@pytest.mark.parametrize(("threshold", "block_rows"), [(1.0, 100_000), (1.0, 25), (1.0, 4), (4.1, 30)])
def test_bars_end_where_a_loop_over_doubles_ends_them(spark, threshold, block_rows):
    rng = random.Random(block_rows)
    begin = datetime(2023, 1, 1)
    rows = [("A", begin + timedelta(seconds=k), 0.1, 1.0) for k in range(200)] + [("B", begin + timedelta(seconds=k), rng.randint(0, 4) / 10, 1.0) for k in range(300)] + [("C", begin + timedelta(seconds=k), 0.25, 1.0) for k in range(50)]
    limits = spark.createDataFrame([(x, threshold) for x in "ABC"], "ticker string, threshold double")
    got = B.value_bars(spark.createDataFrame(rows, TICKS), limits, block_rows=block_rows, doubles=True).collect()
    done, left = loop_bars(rows, threshold)
    assert sorted((r.ticker, r.ts, r.volume) for r in got if r.done) == [r[:3] for r in done]
    assert sorted((r.ticker, r.ts, r.volume, r.dollar_volume) for r in got if not r.done) == left
    whole, _ = fold_bars([r for r in rows if r[0] == "A"], threshold)
    assert threshold != 1.0 or len(whole) > sum(r[0] == "A" for r in done)


def test_one_ticker_lies_over_many_tasks(spark):
    """A million ticks of one ticker: the fold's bars, and no block with over twice the mean rows."""
    n = 1_000_000
    t = spark.range(n).select(F.lit("A").alias("ticker"), F.timestamp_micros(F.col("id") * 1000).alias("ts"), (F.pmod(F.xxhash64("id"), F.lit(900)) / 100 + 1).alias("price"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9)) + 1).cast("double").alias("size"))
    kept, held = chains.stored, []
    chains.stored = lambda df, name: held.append((name, out := kept(df, name))) or out
    try:
        bars = B.dollar_bars(t, spark.createDataFrame([("A", 2000.0)], "ticker string, threshold double")).select(F.unix_micros("ts").alias("us"), "dollar_volume").collect()
    finally:
        chains.stored = kept
    sizes = [r["count"] for r in dict(held)["chain-rows"].groupBy("__b").count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 2 * n / len(sizes)
    rows = t.select(F.unix_micros("ts").alias("us"), "price", "size").toArrow().sort_by("us")
    micros, price, size = (rows[c].to_numpy() for c in ("us", "price", "size"))
    units = np.rint(price * size * 1e4).astype(np.int64)
    ends, total = [], 0
    for k, v in enumerate(units.tolist()):
        total += v
        if total >= 20_000_000:
            ends.append((k, total))
            total = 0
    starts = [0, *[k + 1 for k, _ in ends[:-1]]]
    want = [(int(micros[a]), round(v / 1e4, 3)) for a, (_, v) in zip(starts, ends, strict=True)]
    assert sorted((r.us, round(r.dollar_volume, 3)) for r in bars) == want


def test_every_tick_is_a_bar_without_a_threshold(spark):
    rows = [("A", datetime(2023, 1, 1), 1.0, 0.0), ("A", datetime(2023, 1, 2), 2.0, 3.0), ("A", datetime(2023, 1, 3), 0.0, 1.0)]
    got = B.dollar_bars(spark.createDataFrame(rows, TICKS), spark.createDataFrame([("A", 0.0)], "ticker string, threshold double")).collect()
    assert sorted(r.open for r in got) == [0.0, 1.0, 2.0]
    none = spark.createDataFrame([], TICKS)
    assert B.dollar_bars(none, spark.createDataFrame([("A", 1.0)], "ticker string, threshold double")).count() == 0


@pytest.mark.parametrize(("hold", "block_rows"), [(3, 7), (10, 100_000), (0, 9), (40, 12)])
def test_holds_equal_the_counter(spark, hold, block_rows):
    rng = random.Random(hold + block_rows)
    rows = [(t, date(2020, 1, 1) + timedelta(k), rng.random() < 0.2) for t, n in (("A", 200), ("B", 33), ("C", 1)) for k in range(n)]
    want, left, now = [], 0, None
    for t, day, entry in rows:
        if t != now:
            now, left = t, 0
        if left:
            left -= 1
            want.append((day, t, 0.02 if left else 0.0))
        elif entry:
            left = hold
            want.append((day, t, 0.02))
    got = T.hold_entries(spark.createDataFrame(rows, "ticker string, date date, entry boolean"), hold, block_rows=block_rows).collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize(("n", "block_rows"), [(14, 40), (1, 50), (200, 25)])
def test_wilder_atr_equals_the_recursion(spark, n, block_rows):
    rng = np.random.default_rng(n + block_rows)
    rows = []
    for t, m in (("A", 400), ("B", 45), ("C", 1)):
        close = 100 + rng.normal(size=m).cumsum()
        for k, c in enumerate(close.tolist()):
            gone = t == "A" and rng.random() < 0.05
            rows.append((t, date(2020, 1, 1) + timedelta(k), None if gone else c + 1, c - 1, c if rng.random() > 0.05 else None))
    df = spark.createDataFrame(rows, "ticker string, date date, high double, low double, close double")
    got = {(r.ticker, r.date): r.wilder_atr for r in W.wilder_atr(df, n, block_rows).collect()}
    want, now, prev, a = {}, None, None, None
    for t, day, high, low, close in rows:
        if t != now:
            now, prev, a = t, None, None
        ranges = [] if high is None else [high - low, *([abs(high - prev)] if prev is not None else [])]
        if ranges or prev is not None:
            tr = max([*ranges, *([abs(low - prev)] if prev is not None else [])])
            a = tr if a is None else a + (tr - a) / n
            want[t, day] = a
        prev = close
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 * abs(v) for k, v in want.items())
    plan = W.wilder_atr(df, n, block_rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("kind", ["even", "ties", "outliers", "two"])
def test_ranks_are_exact(spark, kind):
    rng = np.random.default_rng(1)
    x = {"even": rng.normal(size=5000), "ties": rng.integers(0, 6, 5000) * 1.0, "outliers": np.exp(rng.normal(size=5000) * 20), "two": np.repeat([1.0, 2.0], [2400, 2600])}[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(5)
    shares = [0.0, 0.01, 0.1, 0.48, 0.5, 0.99, 1.0]
    got, n = S.order_values(df, "x", shares, sorted_rows=50)
    assert n == len(x) and np.allclose(got, np.quantile(x, shares), rtol=1e-12)
    groups = df.where("x is not null").withColumn("g", F.when(F.col("x") > 1.5, "a").otherwise("b"))
    mine = {r.g: r for r in S.group_quantiles(groups, "g", "x", shares, block_rows=300).collect()}
    for g, part in (("a", x[x > 1.5]), ("b", x[x <= 1.5])):
        assert mine[g].n == len(part) and mine[g].most == part.max() and np.allclose(mine[g]["values"], np.quantile(part, shares), rtol=1e-12)


def test_ranks_of_nothing(spark):
    none = spark.createDataFrame([(None,)], "x double")
    assert S.order_values(none, "x", [0.5]) == ([None], 0)
    assert S.winsorize(none, "x").collect() == none.collect()
