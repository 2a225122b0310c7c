"""Unit-root tests and least orders from grouped sums against plain regressions over whole series."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np

from quantframe.operators import stats as S
from quantframe.operators import windows as W
from quantframe.sources.market import bars


def plain(x):
    """Lags, t and p by a regression for each number of lags."""
    x = np.asarray(x, float)
    x = x[np.isfinite(x)]
    if len(x) < 20 or np.ptp(x) == 0:
        return 0, None, 1.0
    d, most = np.diff(x), min(int(np.ceil(12 * (len(x) / 100) ** 0.25)), len(x) // 2 - 2)

    def fit(lags, start):
        y = d[start:]
        a = np.stack([x[start:-1], *[d[start - k : len(d) - k] for k in range(1, lags + 1)], np.ones(len(y))], 1)
        b = np.linalg.lstsq(a, y, rcond=None)[0]
        r, (n, k) = y - a @ b, a.shape
        return n * (np.log(2 * np.pi * (r @ r) / n) + 1) + 2 * k, b[0] / np.sqrt((r @ r) / (n - k) * np.linalg.pinv(a.T @ a)[0, 0])

    best = min(range(most + 1), key=lambda k: fit(k, most)[0])
    t = fit(best, best)[1]
    return best, t, S._dickey_fuller_p(t)


def same(got, want):
    return got.lags == want[0] and (got.t is None) == (want[1] is None) and (want[1] is None or abs(got.t - want[1]) < 1e-6 * max(1, abs(want[1]))) and abs(got.p - want[2]) < 1e-6


def test_all_brands_as_by_regressions(spark):
    b = bars(spark, "/root/testdata/sf0.01").select("ticker", "date", "close").toPandas().sort_values(["ticker", "date"])
    df = spark.createDataFrame(b.assign(x=np.log(b["close"].astype(float)))[["ticker", "date", "x"]], "ticker string, date date, x double")
    got = {r.ticker: r for r in S.unit_roots(df, ["ticker"], "date", "x").collect()}
    want = {t: plain(np.log(rows["close"].to_numpy(float))) for t, rows in b.groupby("ticker")}
    assert got.keys() == want.keys() and all(same(got[t], w) for t, w in want.items())


def test_series_of_many_kinds(spark):
    rng = np.random.default_rng(7)
    e = rng.normal(size=900)
    series = {"walk": 1000 + e.cumsum(), "ar": np.convolve(e, 0.9 ** np.arange(60))[:900], "short": e[:25], "tiny": e[:19], "flat": np.ones(60), "trend": np.arange(300) + e[:300] * 5, "seasonal": np.tile([1.0, 5.0, 2.0, 8.0], 60) + e[:240], "gaps": np.where(rng.random(400) < 0.1, np.nan, e[:400])}
    rows = [(k, t, None if t % 97 == 5 and k == "gaps" else float(v)) for k, x in series.items() for t, v in enumerate(x)]
    got = {r.s: r for r in S.unit_roots(spark.createDataFrame(rows, "s string, t int, x double"), ["s"], "t", "x").collect()}
    for k in series:
        want = plain([v for s, _, v in rows if s == k and v is not None])
        assert same(got[k], want), (k, got[k], want)
    assert S.unit_roots(spark.createDataFrame([], "s string, t int, x double"), ["s"], "t", "x").count() == 0


def test_least_order_as_by_search(spark):
    rng = np.random.default_rng(3)
    e = rng.normal(size=420)
    series = {"noise": e, "walk": e.cumsum(), "twice": e.cumsum().cumsum(), "near": np.convolve(e, 0.97 ** np.arange(200))[:420], "long": np.convolve(e, (1 + np.arange(300)) ** -0.7)[:420], "short": e[:30].cumsum()}

    def search(x):
        def passes(k):
            w = np.array(W.frac_weights(k / 100)) if k else np.ones(1)
            return len(x) >= len(w) + 20 and plain(np.convolve(x, w, "valid"))[2] < 0.05

        coarse = next((k for k in range(0, 101, 10) if passes(k)), None)
        if not coarse:
            return 0.0 if coarse == 0 else 1.0
        low = int(max(0.0, coarse / 100 - 0.1) * 100)
        return next((k for k in range(low, coarse) if passes(k)), coarse) / 100

    rows = [(k, date(2020, 1, 1) + timedelta(t), float(v)) for k, x in series.items() for t, v in enumerate(x)]
    got = {r.ticker: r.d for r in W.least_order(spark.createDataFrame(rows, "ticker string, date date, x double"), "x").collect()}
    assert got == {k: search(x) for k, x in series.items()}
