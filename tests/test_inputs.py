"""Registered queries over whole small inputs, against brute force."""

from __future__ import annotations

import math
import random
import tracemalloc
from datetime import date, datetime, timedelta

import pyarrow as pa

import __spark_entry__ as entry
from quantframe.operators import execution as X
from quantframe.operators import joins as J
from quantframe.operators import windows as W
from quantframe.sources import files, market


def orders(spark, tmp_path, n=400, customers=30):
    rng = random.Random(31)
    rows = []
    for k in range(1, n + 1):
        at = datetime(1995, 1, 1) + timedelta(days=rng.randrange(2500))
        rows.append((k, rng.randrange(1, customers + 1), at, f"{rng.randint(1, 5)}-X", float(rng.randint(1, 1000))))
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    return rows


def month_ends():
    firsts = [date(y, m, 1) for y in range(1995, 2002) for m in range(1, 13)] + [date(2002, 1, 1)]
    return [d - timedelta(days=1) for d in firsts[1:]]


def test_every_membership_interval_counts(spark, tmp_path):
    rows, want = orders(spark, tmp_path), []
    for c in range(1, 31):
        added = sorted(r[2].date() for r in rows if r[1] == c and r[0] % 2 == 0)
        removed = sorted(r[2].date() for r in rows if r[1] == c and r[0] % 2)
        for a in added:
            end = next((x for x in removed if x > a), None)
            if end:
                removed.remove(end)
            want.append((f"C{c}", a, end))
    run = lambda name: [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
    inside = lambda d: {t for t, a, e in want if a <= d and (e is None or e > d)}
    key = lambda r: (r[0], r[1], str(r[2]))
    assert len(want) > 2 * len({t for t, *_ in want})
    assert sorted(run("src15"), key=key) == sorted(want, key=key)
    assert sorted(run("prj13")) == sorted((t,) for t in inside(date(1998, 1, 1)))
    assert sorted(run("jon14")) == sorted((d, t) for d in month_ends() for t in inside(d))


def test_every_order_can_be_a_report(spark, tmp_path):
    first = {}
    for k, c, at, priority, price in orders(spark, tmp_path):
        first.setdefault((f"Brand#{c % 25 + 1}", at.date()), ({"1": "bmo", "2": "amc"}.get(priority[0], ""), price, price * (1 + (k % 21 - 10) / 100)))
    want = sorted((*k, *v) for k, v in first.items())
    got = sorted(tuple(r) for r in entry.queries()["src12"](spark, str(tmp_path)).collect())
    assert [r[:4] for r in got] == [r[:4] for r in want] and all(abs(g[4] - w[4]) < 1e-9 for g, w in zip(got, want, strict=True))
    assert len(entry.queries()["src07"](spark, str(tmp_path)).collect()) == len(want)
    assert {tuple(r)[:2] for r in entry.queries()["src06"](spark, str(tmp_path)).collect()} == {k for k in first if k[1].year == 1998}


def test_pages_give_their_whole_text(spark, tmp_path):
    words = [f"w{k}" for k in range(5000)]
    page = "<html><script>x</script><body>" + "\n".join(f"<p>{w}</p>" for w in words) + "</body></html>"
    spark.createDataFrame([(1, page), (2, None)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in entry.queries()["src25"](spark, str(tmp_path)).collect()}
    assert got == {1: " ".join(words), 2: None} and len(got[1]) > 12_000


def test_pages_are_taken_a_few_at_a_time(spark, tmp_path):
    pages = pa.array([f"<p>{k}</p>" + "<b>word</b> " * 100 for k in range(1000)] + [None])
    tracemalloc.start()
    texts = files._html_text(pages)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(texts) == 1001 and texts[7].as_py().split() == ["7"] + ["word"] * 100 and texts[1000].as_py() is None
    assert most < pages.nbytes / 4
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    spark.createDataFrame([(1, "<p>a</p>")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert entry.queries()["src25"](spark, str(tmp_path)).first().text == "a"
    assert int(spark.conf.get(key).rstrip("b")) <= 8 << 20


def test_first_exhibit_of_a_filing(spark):
    heads = [
        "&lt;TYPE&gt;8-K\n&lt;FILENAME&gt;a.htm\n&lt;TYPE&gt;ex-99.1 \n&lt;SEQUENCE&gt;2\n&lt;FILENAME&gt;b.htm\n&lt;TYPE&gt;EX-99.2\n&lt;FILENAME&gt;c.htm",
        "<TYPE>8-K<FILENAME>a.htm<TYPE>EX-10<FILENAME>d.htm",
        "",
        None,
    ]
    rows = spark.createDataFrame([(k, h) for k, h in enumerate(heads)], "k int, h string").select("k", files.first_exhibit("h").alias("name"))
    assert {r.k: r.name for r in rows.collect()} == {0: "b.htm", 1: None, 2: None, 3: None}


def trades(spark, tmp_path, days=70, names=3):
    """One or two trades of each name on most days; prices by (ticker, date): open, close."""
    rng = random.Random(32)
    rows, px = [], {}
    for k in range(days):
        for t in range(1, names + 1):
            if rng.random() < 0.8:
                at = date(1997, 1, 10) + timedelta(days=k)
                o, c = (round(50 + t + rng.uniform(-9, 9), 2) for _ in range(2))
                rows += [(k * 10, t, t, 1, o, 1.0, at), (k * 10 + 1, t, t, 1, c, 1.0, at)]
                px[f"Brand#{t}", at] = (o, c)
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(t, f"Brand#{t}") for t in range(1, names + 1)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    return px


def test_every_bar_is_labelled(spark, tmp_path):
    px = trades(spark, tmp_path, days=360)
    want = {"lab01": [], "lab02": []}
    for t in sorted({t for t, _ in px}):
        days = sorted(d for n, d in px if n == t)
        close = [px[t, d][1] for d in days]
        for i in range(21, len(days) - 1):
            atr = sum(abs(close[j] - close[j - 1]) for j in range(i - 20, i + 1)) / 21
            for name, entry_px in (("lab01", close[i]), ("lab02", px[t, days[i]][0] if days[i].month % 2 == 0 else close[i])):
                ahead = range(i + 1, min(i + 20, len(days) - 1) + 1)
                hit = next((j for j in ahead if close[j] >= entry_px + 2 * atr or close[j] <= entry_px - atr), None)
                j = ahead[-1] if hit is None else hit
                label = 0 if hit is None else 1 if close[j] >= entry_px + 2 * atr else -1
                want[name].append((t, days[i], days[j], label, round(close[j] / entry_px - 1, 6)))
    for name, rows in want.items():
        got = sorted(tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect())
        assert [r[:4] for r in got] == [r[:4] for r in sorted(rows)]
        assert all(abs(g[4] - w[4]) < 2e-6 for g, w in zip(got, sorted(rows), strict=True))
    decided = {(r[0], r[1]) for r in want["lab01"] if r[3]}
    scored = {(r.ticker, r.t0) for r in entry.queries()["lab03"](spark, str(tmp_path)).collect()}
    assert scored <= decided and len({d.day for _, d in scored}) > 1


def test_a_forest_reads_trades_once(spark, tmp_path):
    px = trades(spark, tmp_path, days=360)
    out = entry.queries()["lab03"](spark, str(tmp_path))
    assert not [f for f in out.inputFiles() if "lineitem" in f or "part.parquet" in f]
    assert {(r.ticker, r.t0) for r in out.collect()} <= px.keys() and out.count() > 100


def test_backtests_are_those_of_a_loop(spark, tmp_path):
    px = trades(spark, tmp_path)
    days = sorted({d for _, d in px})

    def loop(targets, cost, most):
        nav, held, last, out = 100_000.0, {}, {}, {}
        decided = {}
        for d in days:
            now = {t: o for (t, x), (o, _) in px.items() if x == d}
            gain = {t: o / last[t] - 1 for t, o in now.items() if t in last}
            g = sum(w * gain.get(t, 0.0) for t, w in held.items())
            drift = {t: w * (1 + gain.get(t, 0.0)) / (1 + g) for t, w in held.items()}
            new = {t: min(w, most) for t, w in decided.items() if t in now}
            nav *= (1 + g) * (1 - cost / 1e4 * sum(abs(new.get(t, 0.0) - drift.get(t, 0.0)) for t in new.keys() | drift.keys()))
            out[d], held, decided, last = nav, new, targets(d, now), last | now
        return out

    equal = lambda d, now: {t: 1 / len(now) for t in now}
    want = {d: round(math.log(x), 6) for d, x in loop(equal, 0.0, 1.0).items()}
    got = {r.date: r.log_nav for r in entry.queries()["exe04"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 2e-6 for d in want)
    odd = lambda d, now: {t: 0.2 + 0.1 * (d.day % 3) for t in now if (d.day + int(t[-1])) % 2}
    rows = [("r", d, t, w) for d in days for t, w in odd(d, [t for t, x in px if x == d]).items()]
    t = spark.createDataFrame(rows, "run string, date date, ticker string, weight double")
    got = {r.date: r.nav for r in X.backtest(t, market.bars(spark, str(tmp_path)), cost_bps=25.0, most=0.3).collect()}
    want = loop(odd, 25.0, 0.3)
    assert set(got) >= {r[1] for r in rows} and all(abs(got[d] / want[d] - 1) < 1e-9 for d in got)


def test_open_spans_and_memberships_have_no_end(spark):
    ev = spark.sql("select * from values ('A', timestamp '2190-05-01 10:00:00', 1), ('A', timestamp '1997-05-01 10:00:00', 2) as e(ticker, ts, n)")
    spans = spark.sql("select * from values ('A', timestamp '1998-01-01 00:00:00', cast(null as timestamp)), ('A', timestamp '1997-01-01 00:00:00', timestamp '1997-06-01 00:00:00') as s(ticker, s, e)")
    assert sorted(r.n for r in J.in_interval(ev, spans, ["ticker"], "ts", "s", "e", bucket_days=30).collect()) == [1, 2]
    iv = spark.sql("select 'A' as ticker, date '2001-11-05' as date_added, cast(null as date) as date_removed")
    dates = spark.sql("select explode(array(date '2001-12-31', date '2030-01-31')) as date")
    assert J.members_by_date(iv, dates).count() == 2 and J.members_by_date(iv, dates.limit(0)).count() == 0


def test_orders_by_row_difference_as_one_order_does(spark):
    rng = random.Random(5)
    orders = {"A": 0.0, "B": 0.07, "C": 0.4, "D": 1.0, "E": None}
    rows = [(t, date(2000, 1, 1) + timedelta(days=k), None if (t, k) == ("C", 150) else rng.uniform(1, 9), v) for t, v in orders.items() for k in range(180)]
    b = spark.createDataFrame(rows, "ticker string, date date, close double, d double")
    got = {(r["ticker"], r["date"]): r["frac"] for r in W.frac_diff_by(b, "close", "d").collect()}
    want = {}
    for t, v in orders.items():
        if v is not None:
            want |= {(t, r["date"]): r["frac"] for r in W.frac_diff(b.where(f"ticker = '{t}'"), "close", v).collect()}
    assert got == want and {t for t, _ in got} == set("ABCD")


def test_samples_of_names(spark):
    names = spark.createDataFrame([(f"N{k % 500}",) for k in range(700)], "name string")
    one, two = (sorted(r.name for r in files.sample_names(x, "name", 40).collect()) for x in (names, names.repartition(7)))
    assert one == two and len(set(one)) == 40
    assert files.sample_names(names, "name", 0).count() == 500 and files.sample_names(names, "name").count() == 400


def test_missing_parts(spark):
    cache = spark.createDataFrame([("A", 1), ("A", 2), ("B", 2), ("B", 2)], "k string, m int")
    whole = spark.createDataFrame([(1,), (2,), (3,)], "m int")
    assert sorted(map(tuple, files.missing_parts(cache, whole, "k", "m").collect())) == [("A", 3), ("B", 1), ("B", 3)]


def test_zero_width_spaces_go(spark):
    page = spark.createDataFrame([("<p>a​ ​ b</p><script>x</script>",)], "html string")
    assert page.select(files.html_text("html")).first()[0] == "a b"
