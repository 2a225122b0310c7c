"""Golden literals and invariants of the engine's own operators."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantframe.functions.expr import normal_cdf, pct_rank, skew, surprise, z_score
from quantframe.operators import bars as B
from quantframe.operators import catalog as K
from quantframe.operators import clean as C
from quantframe.operators import execution as X
from quantframe.operators import joins as J
from quantframe.operators import labels as L
from quantframe.operators import stats as S
from quantframe.operators import strategies as T
from quantframe.operators import windows as W
from quantframe.sources import files, market
from quantframe.sources import manifest as M

D0 = date(2024, 1, 1)


def bdays(n, start=D0):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def panel(spark, closes, start=D0, volume=1e6):
    rows = []
    for t, cs in closes.items():
        for d, c in zip(bdays(len(cs), start), cs, strict=True):
            if c is not None:
                rows.append((t, d, c * 0.995, c * 1.01, c * 0.99, float(c), volume))
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")


def series(spark, **named):
    rows = [(k, d, float(r)) for k, rs in named.items() for d, r in zip(bdays(len(rs)), rs, strict=True)]
    return spark.createDataFrame(rows, "series_id string, date date, ret double")


def test_drawdown_literals(spark):
    r = series(spark, a=[0.5, -1 / 3, 0.2], b=[-0.2, -0.2, -0.2, 0.01, 0.01], c=[-0.2, 0.5])
    got = {x.series_id: round(x.max_drawdown, 4) for x in S.drawdown(r).collect()}
    assert got == {"a": 0.3333, "b": 0.488, "c": 0.2}
    assert S.drawdown(r.limit(0)).count() == 0


def test_frac_diff_identity_and_difference(spark):
    p = panel(spark, {"A": [10.0, 11.0, 13.0, 12.0]})
    assert sorted(x.frac for x in W.frac_diff(p, "close", 0.0).collect()) == [10, 11, 12, 13]
    ones = {x.date: x.frac for x in W.frac_diff(p, "close", 1.0).collect()}
    assert [round(v, 9) for _, v in sorted(ones.items())][-2:] == [2.0, -1.0]
    assert max(len(W.frac_weights(k / 100)) for k in range(1, 100)) == 75


def test_features_do_not_look_ahead(spark):
    rng = np.random.default_rng(1)
    c = (100 * np.cumprod(1 + rng.normal(0, 0.01, 120))).tolist()
    changed = c[:80] + [x * 3 for x in c[80:]]
    for feature, name in ((W.rsi, "rsi_14"), (W.volatility, "vol_21d"), (W.from_high, "pct_from_high"), (W.atr, "atr"), (W.wilder_atr, "wilder_atr")):
        cut = bdays(120)[79]
        a, b = ({x.date: x[name] for x in feature(panel(spark, {"A": s})).where(F.col("date") <= cut).collect()} for s in (c, changed))
        assert a == b


def test_days_since_reaction_and_surprise(spark):
    days = bdays(10)
    p = panel(spark, {"A": range(1, 11), "B": range(1, 11)})
    rep = spark.createDataFrame(
        [("A", D0 - timedelta(days=3), "amc", 1.0, 1.0), ("A", days[2], "amc", 1.1, 1.0), ("B", date(2024, 1, 5), "amc", 0.5, 0.0), ("B", date(2024, 1, 6), "", None, 1.0)],
        "ticker string, date date, time string, actual double, estimate double",
    )
    got = {(x.ticker, x.date): x.days_since for x in J.days_since_reaction(p, rep).collect()}
    assert [got["A", d] for d in days[:6]] == [None, None, None, 0, 1, 2]
    assert [got["B", d] for d in days[:7]] == [None] * 5 + [0, 1]
    s = {(x.ticker, x.date): x.surprise for x in J.latest_surprise(p, rep).collect()}
    assert round(s["A", days[2]], 9) == 0.1 and s["B", days[4]] is None and s["B", days[9]] is None


def test_pit_facts_strict_and_late_amendment(spark):
    facts = spark.createDataFrame(
        [("A", date(2024, 3, 31), date(2024, 5, 1), 1.0), ("A", date(2024, 6, 30), date(2024, 8, 1), 2.0), ("A", date(2023, 12, 31), date(2024, 9, 1), 99.0)],
        "ticker string, period_date date, filing_date date, roe double",
    )
    at = [date(2024, 4, 1), date(2024, 5, 1), date(2024, 5, 2), date(2024, 8, 2), date(2024, 9, 3)]
    left = spark.createDataFrame([("A", d) for d in at], "ticker string, date date")
    got = {x.date: x.roe for x in J.pit_facts(left, facts, ["roe"]).collect()}
    assert [got[d] for d in at] == [None, None, 1.0, 2.0, 2.0]


def test_asof_forward_and_plan(spark):
    left = spark.createDataFrame([("A", 1), ("A", 5), ("B", 2)], "k string, t int")
    right = spark.createDataFrame([("A", 1, 10), ("A", 4, 40), ("A", 6, 60)], "k string, rt int, v int")
    got = {(x.k, x.t): x.v for x in J.asof(left, right, ["k"], "t", "rt", ["v"], forward=True).collect()}
    assert got == {("A", 1): 10, ("A", 5): 60, ("B", 2): None}
    plan = J.asof(left, right, ["k"], "t", "rt", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Cartesian" not in plan and "NestedLoop" not in plan


def test_membership_pairs_greedily(spark):
    ch = spark.createDataFrame([("A", date(2020, 1, k), a) for k, a in ((1, "added"), (2, "removed"), (3, "added"), (5, "removed"), (7, "added"))], "ticker string, date date, action string")
    got = sorted((x.date_added.day, x.date_removed and x.date_removed.day) for x in J.membership_intervals(ch).collect())
    assert got == [(1, 2), (3, 5), (7, None)]


def test_benchmark_open_to_open(spark):
    days = bdays(3)
    rows = [("A", d, o) for d, o in zip(days, (100.0, 110.0, 121.0), strict=True)] + [("B", days[0], 50.0), ("B", days[2], 50.0), ("P", days[0], 1.0), ("P", days[1], 3.0)]
    got = {x.date: round(x.ret, 9) for x in B.equal_weight_benchmark(spark.createDataFrame(rows, "ticker string, date date, open double")).collect()}
    assert got == {days[1]: 0.1, days[2]: 0.1}


def test_dollar_bars_reach_the_threshold(spark):
    rows = [("A", datetime(2023, 1, 1) + timedelta(minutes=k), 100.0, float(100 + k % 400)) for k in range(500)]
    t = spark.createDataFrame(rows, "ticker string, ts timestamp, price double, size double")
    got = B.dollar_bars(t, spark.createDataFrame([("A", 50_000.0)], "ticker string, threshold double")).collect()
    assert got and all(x.dollar_volume >= 50_000 for x in got)
    assert sum(x.volume for x in got) <= sum(r[3] for r in rows)


def test_cap_and_normalise(spark):
    t = spark.createDataFrame([("r", D0, "A", 3.0), ("r", D0, "B", 1.0), ("r", D0, "C", -1.0)], "run string, date date, ticker string, weight double")
    assert {x.ticker: x.weight for x in X.normalise(t).collect()} == {"A": 0.75, "B": 0.25}
    held = X.cap(spark.createDataFrame([("r", D0, "AAPL", 0.78), ("r", D0, "MSFT", 0.06)], "run string, date date, ticker string, weight double"))
    assert {x.ticker: round(x.weight * 100_000) for x in held.collect()} == {"AAPL": 10_000, "MSFT": 6_000}


def test_backtest_fills_on_the_next_bar(spark):
    p = panel(spark, {"A": [100.0, 110.0, 121.0]})
    t = spark.createDataFrame([("r", d, "A", 1.0) for d in bdays(3)], "run string, date date, ticker string, weight double")
    nav = {x.date: round(x.nav, 6) for x in X.backtest(t, p, cost_bps=0.0, most=None).collect()}
    assert list(map(nav.get, bdays(3))) == [100_000, 100_000, 110_000]


def test_hold_entries_count_bars(spark):
    rows = [("A", d, k == 1) for k, d in enumerate(bdays(8))]
    got = sorted((x.date, x.weight) for x in T.hold_entries(spark.createDataFrame(rows, "ticker string, date date, entry boolean"), 3).collect())
    assert [w for _, w in got] == [0.02, 0.02, 0.02, 0.0]


def test_triple_barrier_labels(spark):
    c = [100.0 + (k % 2) for k in range(30)] + [110.0] * 5 + [100.0 + (k % 2) for k in range(30)] + [90.0] * 3 + [100.0 + k % 2 for k in range(40)]
    p = panel(spark, {"A": c})
    days = bdays(len(c))
    ev = spark.createDataFrame([("A", days[29]), ("A", days[64]), ("A", days[104]), ("A", days[2])], "ticker string, t0 date")
    got = {x.t0: (x.t1, x.label) for x in L.triple_barrier(p, ev).collect()}
    assert got[days[29]] == (days[30], 1) and got[days[64]] == (days[65], -1) and days[2] not in got
    assert got[days[104]][1] == 0 and got[days[104]][0] == days[-1]


def test_cpcv_counts_and_disjointness(spark):
    days = spark.createDataFrame([(d,) for d in bdays(600, date(2018, 1, 1))], "date date")
    s = L.cpcv(days).toPandas()
    assert s["split"].nunique() == 15 and not s.duplicated(["split", "date"]).any()
    assert L.runner_folds(L.cpcv(days, groups=4)).count() == 9
    with pytest.raises(ValueError):
        L.cpcv(days, groups=2, test=2)


def test_business_days_match_numpy(spark):
    days = [D0 + timedelta(days=k) for k in range(30)]
    df = spark.createDataFrame([(d,) for d in days], "date date")
    for n in (-20, -7, -1, 1, 5, 8, 63):
        got = {x.date: x.m for x in df.withColumn("m", L.business_day("date", n)).collect()}
        roll = "forward" if n < 0 else "backward"
        assert got == {d: np.busday_offset(d, n, roll=roll).astype(object) for d in days}


def test_statistics(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0.001, 0.015, 252)
    r = series(spark, a=x)
    z = S.psr_z(r, ["series_id"]).first()
    s = pd.Series(x)
    assert abs(z["skew"] - s.skew()) < 1e-9 and abs(z["kurt"] - s.kurt()) < 1e-9
    assert 0 < S.psr(r, ["series_id"]).first()["psr"] < 1
    assert S.expected_max_sharpe(1) == 0 < S.expected_max_sharpe(10) < S.expected_max_sharpe(100)
    assert S.ROUND_TRIP == 11
    assert abs(S.student_tail(2.0, 10) - 0.0733880) < 1e-6 and S.student_tail(0.0, 5) == 1.0
    five = spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, 8.0, 20.0)], "v double").agg(skew("v").alias("s")).first().s
    assert abs(five - 1.6406) < 1e-3
    assert abs(spark.range(1).select(normal_cdf(F.lit(1.96)).alias("p")).first().p - 0.9750021) < 1e-6


def test_benchmark_alpha_and_exact_copy(spark):
    rng = np.random.default_rng(7)
    b = rng.normal(0, 0.01, 250)
    r = series(spark, lev=1.5 * b + 0.0002 + rng.normal(0, 1e-4, 250), copy=b)
    bench = spark.createDataFrame([(d, float(v)) for d, v in zip(bdays(250), b, strict=True)], "date date, b double")
    got = {x.series_id: x for x in S.benchmark_alpha(r, bench).collect()}
    assert abs(got["lev"].beta - 1.5) < 0.01 and got["lev"].alpha_t > 5 and got["lev"].alpha_p < 1e-4
    assert got["copy"].alpha_t == 0 and abs(got["copy"].beta - 1) < 1e-9


def test_multi_ols_and_clusters(spark):
    rng = np.random.default_rng(3)
    n = 400
    a, b, e = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    y = 1 + 2 * a - b + e
    rows = [("s", int(k // 10), float(y[k]), float(a[k]), float(b[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "s string, g int, y double, a double, b double")
    fit = S.multi_ols(df, ["s"], "y", ["a", "b"]).first()
    x = np.stack([np.ones(n), a, b], 1)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.allclose(fit.coefs, beta)
    c = S.cluster_ols(df, "y", ["a", "b"], "g")
    u = y - x @ beta
    scores = np.stack([(x[k * 10 : k * 10 + 10] * u[k * 10 : k * 10 + 10, None]).sum(0) for k in range(40)])
    inv = np.linalg.inv(x.T @ x)
    cov = inv @ scores.T @ scores @ inv * 40 / 39 * (n - 1) / (n - 3)
    assert np.allclose(c["tstats"], beta / np.sqrt(np.diag(cov))) and c["clusters"] == 40


def test_unit_root(spark):
    rng = np.random.default_rng(5)
    noise = rng.normal(size=500)
    series = {"noise": noise, "walk": noise.cumsum(), "flat": np.ones(50), "short": noise[:10]}
    rows = [(k, t, float(v)) for k, x in series.items() for t, v in enumerate(x)]
    p = {r.s: r.p for r in S.unit_roots(spark.createDataFrame(rows, "s string, t int, x double"), ["s"], "t", "x").collect()}
    assert p["noise"] < 0.01 < 0.05 < p["walk"] and p["flat"] == p["short"] == 1.0


def test_ranks_and_scores(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 3.0), (1, None)], "g int, x double")
    got = sorted((x.x or 0, x.r) for x in df.withColumn("r", pct_rank("x", ["g"])).collect())
    assert got == [(0, None), (1.0, 0.5), (1.0, 0.5), (3.0, 1.0)]
    assert all(x.z == 0 for x in spark.createDataFrame([(1, 2.0), (1, 2.0)], "g int, x double").withColumn("z", z_score("x", ["g"])).collect())
    assert spark.range(1).select(surprise(F.lit(1.0), F.lit(0.0)).alias("s")).first().s is None


def test_quantile_selection(spark):
    df = spark.createDataFrame([(1, f"T{k}", float(k)) for k in range(10)] + [(2, "x", 1.0)], "d int, ticker string, s double")
    top = C.top_quantile(df, "s", ["d"]).collect()
    assert sorted(x.ticker for x in top) == ["T8", "T9"] and sum(x.weight for x in top) == 1


def test_sizing_and_book(spark):
    one = spark.createDataFrame([(0.1, 1.0), (0.5, 1.0), (0.1, 0.4), (-1.0, 1.0)], "raw double, conf double")
    assert [round(x.s, 6) for x in one.select(X.size("raw", "conf").alias("s")).collect()] == [0.025, 0.05, 0.0, 0.0]
    b = spark.createDataFrame([(D0, "a", "X", 0.04), (D0, "b", "X", 0.03)], "date date, signal string, ticker string, size double")
    assert X.combine_book(b).first().weight == 0.05


def test_risk_latch(spark):
    path = [(100_000, False), (99_000, False), (94_000, False), (95_000, False), (95_500, True), (95_600, False), (80_000, False)]
    df = spark.createDataFrame([("a", d, float(e), r) for d, (e, r) in zip(bdays(7), path, strict=True)], "account string, date date, equity double, resume boolean")
    assert [x.halted for x in X.risk_latch(df).orderBy("date").collect()] == [False, False, True, True, False, False, True]


def test_catalog(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, s string")
    assert sorted(tuple(x) for x in K.upsert(t, new, ["id"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(tuple(x) for x in K.upsert(t, new, ["id"], replace=False).collect()) == [(1, "a"), (2, "b"), (3, "d")]
    path = f"file://{tmp_path}/t"
    M.replace_table(t, path)
    M.replace_table(K.upsert(M.read_table(spark, path), new, ["id"]), path)
    assert M.read_table(spark, path).count() == 3
    faults = spark.createDataFrame([("too short", "value"), ("word " * 25, "macro"), ("word " * 25 + "Has worked", "odd")], "t string, c string")
    assert [x.f for x in faults.select(K.knowledge_faults("t", "c").alias("f")).collect()] == [["short"], [], ["fitted", "cohort"]]
    with pytest.raises(ValueError):
        K.checked_expression(spark, "os + 1", ["close"])
    with pytest.raises(Exception):
        K.checked_expression(spark, "nothing + 1", ["close"])
    assert K.floor_streak(spark.createDataFrame([("s", d, w) for d, w in zip(bdays(4), (0.3, 1.0, 0.3, 0.3), strict=True)], "name string, date date, weight double")).first().streak == 2


def test_files(spark, tmp_path):
    p = panel(spark, {"A": [1.0, 2.0, 3.0]})
    files.write_years(p, f"{tmp_path}/bars")
    back = spark.read.parquet(f"{tmp_path}/bars")
    assert back.count() == 3
    files.append_days(panel(spark, {"A": [1.0, 2.0, 3.0, 4.0]}), back, f"{tmp_path}/bars")
    assert spark.read.parquet(f"{tmp_path}/bars").count() == 4
    (tmp_path / "x.csv").write_text("date,value\n2024-01-01,1.5\n2024-01-02,.\n")
    assert [x.value for x in files.read_series_csv(spark, f"{tmp_path}/x.csv").orderBy("date").collect()] == [1.5, None]
    html = spark.createDataFrame([("<p>Hello  <b>there</b></p><script>no()</script>",), (None,)], "h string")
    assert [x.t for x in html.select(files.html_text("h").alias("t")).collect()] == ["Hello there", None]
    assert C.redact(F.lit("x")) is not None
    assert spark.range(1).select(C.redact(F.lit("u?apikey=abc&y=1")).alias("u")).first().u == "u?apikey=***&y=1"


def test_holdout_guard():
    for a, b in ((market.HOLDOUT[0], market.HOLDOUT[0]), (date(1990, 1, 1), market.HOLDOUT[0]), (market.HOLDOUT[1], date(2010, 1, 1))):
        with pytest.raises(PermissionError):
            market.check_holdout(a, b)
    market.check_holdout(date(1990, 1, 1), market.HOLDOUT[0] - timedelta(days=1))


def test_transcript_scores(spark):
    df = spark.createDataFrame([("Record strong growth, robust!",), ("loss weak decline risk declined",), ("",), (None,)], "t string")
    s = [x.s for x in df.select(T.transcript_score(F.col("t")).alias("s")).collect()]
    assert s[0] > 0 > s[1] and s[2] == s[3] == 0


def plain_elimination(wide: pd.DataFrame, adaptive: bool) -> dict:
    """The same rule over a frame of days by series."""
    book, out, step = list(wide.columns), {}, 0
    while True:
        step += 1
        stats = {}
        for c in book:
            both = pd.DataFrame({"y": wide[c], "x": wide[[x for x in book if x != c]].mean(axis=1)}).dropna()
            stats[c] = (len(both), None)
            if len(both) >= 30 and both["x"].std() > 0:
                beta, alpha = np.polyfit(both["x"], both["y"], 1)
                rest = both["y"] - alpha - beta * both["x"]
                s2 = (rest**2).sum() / (len(both) - 2)
                if s2 > 1e-20:
                    stats[c] = (len(both), alpha / np.sqrt(s2 * (1 / len(both) + both["x"].mean() ** 2 / ((both["x"] - both["x"].mean()) ** 2).sum())))
        gate = S.min_alpha_t(len(book) if adaptive else wide.shape[1])
        failing = sorted((t, c) for c, (_, t) in stats.items() if t is not None and t < gate)
        if not failing or len(book) < 2:
            return out | {c: (None, *v) for c, v in stats.items()}
        out[failing[0][1]] = (step, *stats[failing[0][1]])
        book.remove(failing[0][1])


@pytest.mark.parametrize("adaptive", [False, True])
def test_backward_elimination_is_the_plain_rule(spark, adaptive):
    rng = np.random.default_rng(7)
    market = rng.normal(0, 0.01, 800)
    wide = pd.DataFrame({f"s{k}": 0.7 * market + rng.normal(0.0004 * k, 0.008, 800) for k in range(12)}, index=pd.bdate_range("2020-01-01", periods=800))
    wide.iloc[:300, 3] = np.nan
    wide.iloc[500:, 5] = np.nan
    wide.iloc[rng.integers(0, 800, 60), 8] = np.nan
    wide.iloc[20:, 9] = np.nan  # too few days
    wide["flat"] = 0.0
    long = wide.reset_index(names="date").melt("date", var_name="series_id", value_name="ret")
    long["date"] = long["date"].dt.date
    df = spark.createDataFrame(long.astype({"ret": object}).where(long["ret"].notna(), None), "date date, series_id string, ret double")
    got = {r.series_id: (r.step, r.n, r.alpha_t) for r in S.backward_elimination(df, adaptive=adaptive).collect()}
    want = plain_elimination(wide, adaptive)
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert all(got[k][2] == (None if v[2] is None else pytest.approx(v[2], rel=1e-6)) for k, v in want.items())
    assert any(v[0] for v in want.values()) and any(v[0] is None for v in want.values())
    assert S.backward_elimination(df.limit(0)).count() == 0
    one = S.backward_elimination(df.where("series_id = 's1'")).collect()
    assert [(r.series_id, r.step, r.n, r.alpha_t) for r in one] == [("s1", None, 0, None)]
