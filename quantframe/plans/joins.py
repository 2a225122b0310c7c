"""Join and set queries (JON, SET)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import change
from ..operators import joins as J
from ..sources.market import bars, filings, macro, reports, returns, sql, table
from .registry import query

_TOP = "SELECT ticker, date, close FROM bars"
_B2 = "SELECT date, close AS a FROM bars WHERE ticker = 'Brand#1'"
_C2 = "SELECT date, close AS b FROM bars WHERE ticker = 'Brand#2'"


def two(spark, d):
    b = bars(spark, d)
    one = lambda t, n: b.where(F.col("ticker") == t).select("date", F.col("close").alias(n))
    return one("Brand#1", "a"), one("Brand#2", "b")


@query("jon01", sql(f"SELECT date, a, b FROM ({_B2}) JOIN ({_C2}) USING (date)", "bars"))
def jon01(spark, d):
    a, b = two(spark, d)
    return a.join(b, "date", "inner")


@query("jon02", sql(f"SELECT date, a, b FROM ({_B2}) LEFT JOIN ({_C2}) USING (date)", "bars"))
def jon02(spark, d):
    a, b = two(spark, d)
    return a.join(b, "date", "left")


@query("jon03", sql(f"SELECT date, a, b FROM ({_B2}) FULL JOIN ({_C2}) USING (date)", "bars"))
def jon03(spark, d):
    a, b = two(spark, d)
    return a.join(b, "date", "full_outer")


_SUR = "SELECT ticker, date, (actual - estimate) / nullif(abs(estimate), 0) AS surprise FROM reports"


@query("jon04", sql(f"SELECT b.ticker, b.date, ROUND(r.surprise, 6) AS surprise FROM bars b ASOF LEFT JOIN ({_SUR}) r ON b.ticker = r.ticker AND b.date >= r.date", "bars", "reports"))
def jon04(spark, d):
    return J.latest_surprise(bars(spark, d), reports(spark, d)).select("ticker", "date", F.round("surprise", 6).alias("surprise"))


_NEWEST = """newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, period_date ORDER BY filing_date) AS k FROM (
    SELECT *, max(period_date) OVER (PARTITION BY ticker ORDER BY filing_date, period_date ROWS UNBOUNDED PRECEDING) AS top FROM filings) WHERE top = period_date) WHERE k = 1)"""


@query("jon05", sql("", "bars", "filings").rstrip() + f", {_NEWEST} SELECT b.ticker, b.date, ROUND(n.roe, 8) AS roe, n.period_date FROM bars b ASOF LEFT JOIN newest n ON b.ticker = n.ticker AND b.date > n.filing_date")
def jon05(spark, d):
    return J.pit_facts(bars(spark, d), filings(spark, d), ["roe", "period_date"]).select("ticker", "date", F.round("roe", 8).alias("roe"), "period_date")


@query("jon06", sql("", "filings").rstrip() + f", {_NEWEST} SELECT ticker, period_date, filing_date FROM newest")
def jon06(spark, d):
    return J.newest_periods(filings(spark, d)).select("ticker", "period_date", "filing_date")


@query(
    "jon07",
    sql("SELECT b.ticker, b.date, m.a, m.b FROM bars b ASOF LEFT JOIN (SELECT '1' AS k, * FROM macro) m ON m.k = '1' AND b.date >= m.date", "bars", "macro"),
)
def jon07(spark, d):
    """Row-level: NULLs within the matched row stay NULL. The calendar of days is small, so days are matched, then looked up."""
    days = bars(spark, d).select("date").distinct().withColumn("k", F.lit(1))
    m = macro(spark, d).select(F.lit(1).alias("k"), F.col("date").alias("mdate"), "a", "b")
    at = J.asof(days, m, ["k"], "date", "mdate", ["a", "b"]).drop("k")
    return bars(spark, d).select("ticker", "date").join(at, "date").select("ticker", "date", "a", "b")


@query(
    "jon08",
    sql("", "bars", "macro").rstrip()
    + ", full_macro AS (SELECT '1' AS k, date, last_value(a IGNORE NULLS) OVER w AS a, last_value(b IGNORE NULLS) OVER w AS b FROM macro WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)) SELECT b.ticker, b.date, m.a, m.b FROM bars b ASOF LEFT JOIN full_macro m ON m.k = '1' AND b.date >= m.date",
)
def jon08(spark, d):
    """Each value carried forward on the macro calendar first."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    m = macro(spark, d).select(F.lit(1).alias("k"), F.col("date").alias("mdate"), F.last("a", True).over(w).alias("a"), F.last("b", True).over(w).alias("b"))
    days = bars(spark, d).select("date").distinct().withColumn("k", F.lit(1))
    at = J.asof(days, m, ["k"], "date", "mdate", ["a", "b"]).drop("k")
    return bars(spark, d).select("ticker", "date").join(at, "date").select("ticker", "date", "a", "b")


_REACT = """reactions AS (SELECT r.ticker, r.date, r.time, r.actual, r.estimate, (SELECT min(b.date) FROM bars b WHERE b.ticker = r.ticker AND b.date >= r.date + CASE WHEN r.time = 'bmo' THEN 0 ELSE 1 END) AS reaction
    FROM reports r WHERE r.date >= (SELECT min(b.date) FROM bars b WHERE b.ticker = r.ticker))"""


@query("jon09", sql("", "bars", "reports").rstrip() + f", {_REACT} SELECT ticker, date, time, reaction FROM reactions WHERE reaction IS NOT NULL")
def jon09(spark, d):
    return J.reaction_bars(reports(spark, d), bars(spark, d)).select("ticker", "date", "time", "reaction")


@query("jon10", sql("", "bars", "reports").rstrip() + f", {_REACT} SELECT ticker, date, time FROM reactions WHERE reaction BETWEEN DATE '1998-06-15' AND DATE '1998-06-19'")
def jon10(spark, d):
    """Reports that react in a given week's sessions."""
    return J.reaction_bars(reports(spark, d), bars(spark, d)).where("reaction between date '1998-06-15' and date '1998-06-19'").select("ticker", "date", "time")


@query(
    "win08",
    sql("", "bars", "reports").rstrip()
    + f", {_REACT} SELECT ticker, date, CAST(n - max(CASE WHEN hit THEN n END) OVER (PARTITION BY ticker ORDER BY date) AS DOUBLE) AS days_since FROM (SELECT b.ticker, b.date, row_number() OVER (PARTITION BY b.ticker ORDER BY b.date) AS n, r.reaction IS NOT NULL AS hit FROM bars b LEFT JOIN (SELECT DISTINCT ticker, reaction FROM reactions) r ON r.ticker = b.ticker AND r.reaction = b.date)",
)
def win08(spark, d):
    return J.days_since_reaction(bars(spark, d), reports(spark, d)).select("ticker", "date", F.col("days_since").cast("double").alias("days_since"))


_MAP = "(VALUES ('BUILDING', 'XLB'), ('MACHINERY', 'XLI'), ('HOUSEHOLD', 'XLP')) m(seg, etf)"


@query("jon11", f"SELECT c_custkey, coalesce(m.etf, 'SPY') AS etf FROM customer LEFT JOIN {_MAP} ON m.seg = c_mktsegment")
def jon11(spark, d):
    m = spark.createDataFrame([("BUILDING", "XLB"), ("MACHINERY", "XLI"), ("HOUSEHOLD", "XLP")], "seg string, etf string")
    c = table(spark, d, "customer")
    return c.join(F.broadcast(m), c["c_mktsegment"] == m["seg"], "left").select("c_custkey", F.coalesce("etf", F.lit("SPY")).alias("etf"))


_SPANS = """days AS (SELECT DISTINCT event_type AS ticker, CAST(ts AS DATE) AS date FROM events),
    spans AS (SELECT ticker, date, CAST(lag(date) OVER (PARTITION BY ticker ORDER BY date) AS TIMESTAMP) + INTERVAL 16 HOUR AS s, CAST(date AS TIMESTAMP) + INTERVAL 570 MINUTE AS e FROM days)"""


def _event_spans(spark, d):
    ev = table(spark, d, "events").select(F.col("event_type").alias("ticker"), "ts", "event_id")
    days = ev.select("ticker", F.to_date("ts").alias("date")).distinct()
    prev = F.lag("date").over(Window.partitionBy("ticker").orderBy("date"))
    spans = days.select("ticker", "date", (prev.cast("timestamp") + F.expr("interval 16 hours")).alias("s"), (F.col("date").cast("timestamp") + F.expr("interval 570 minutes")).alias("e")).where("s is not null")
    return ev, spans


@query(
    "jon12",
    f"WITH {_SPANS} SELECT ticker, date, event_id FROM (SELECT s.ticker, s.date, v.event_id, row_number() OVER (PARTITION BY s.ticker, s.date ORDER BY v.ts DESC, v.event_id DESC) AS k FROM spans s JOIN events v ON v.event_type = s.ticker AND v.ts >= s.s AND v.ts < s.e) WHERE k <= 3",
)
def jon12(spark, d):
    """Overnight documents of each event day (after the last close, before the open): the newest three."""
    ev, spans = _event_spans(spark, d)
    found = J.in_interval(ev, spans, ["ticker"], "ts", "s", "e", bucket_days=1)
    return J.newest(found, ["ticker", "date"], [F.col("ts").desc(), F.col("event_id").desc()], 3).select("ticker", "date", "event_id")


@query(
    "jon13",
    f"WITH {_SPANS} SELECT s.ticker, s.date, arg_max(v.event_id, v.ts) AS event_id FROM spans s JOIN events v ON v.event_type = s.ticker AND v.ts >= s.s AND v.ts < s.e AND v.value > 50 GROUP BY 1, 2",
)
def jon13(spark, d):
    """Latest document of the window that has content."""
    ev, spans = _event_spans(spark, d)
    full = ev.join(table(spark, d, "events").where("value > 50").select("event_id"), "event_id", "left_semi")
    return J.in_interval(full, spans, ["ticker"], "ts", "s", "e", bucket_days=1).groupBy("ticker", "date").agg(F.max_by("event_id", "ts").alias("event_id"))


_MEMBERS = """WITH RECURSIVE e AS (SELECT 'C' || o_custkey AS ticker, CAST(o_orderdate AS DATE) AS date, o_orderkey % 2 = 0 AS added FROM orders),
    gone AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS j FROM e WHERE NOT added),
    adds AS (SELECT a.ticker, a.date, row_number() OVER (PARTITION BY a.ticker ORDER BY a.date) AS i, (SELECT count(*) FROM gone g WHERE g.ticker = a.ticker AND g.date <= a.date) + 1 AS later FROM e a WHERE added),
    walk AS (SELECT ticker, date, i, later AS j FROM adds WHERE i = 1 UNION ALL SELECT a.ticker, a.date, a.i, greatest(a.later, w.j + 1) FROM walk w JOIN adds a ON a.ticker = w.ticker AND a.i = w.i + 1),
    spans AS (SELECT w.ticker, w.date AS date_added, g.date AS date_removed FROM walk w LEFT JOIN gone g ON g.ticker = w.ticker AND g.j = w.j) """


def _intervals(spark, d):
    o = table(spark, d, "orders")
    c = o.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"), F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderkey") % 2 == 0, "added").otherwise("removed").alias("action"))
    return J.membership_intervals(c)


@query("src15", _MEMBERS + "SELECT * FROM spans")
def src15(spark, d):
    """Every membership interval of every ticker, paired greedily."""
    return _intervals(spark, d)


@query("prj13", _MEMBERS + "SELECT DISTINCT ticker FROM spans WHERE date_added <= DATE '1998-01-01' AND (date_removed IS NULL OR date_removed > DATE '1998-01-01')")
def prj13(spark, d):
    return J.members(_intervals(spark, d), F.lit("1998-01-01").cast("date")).select("ticker").distinct()


@query("jon14", _MEMBERS + "SELECT DISTINCT d.date, ticker FROM spans JOIN (SELECT last_day(m::DATE) AS date FROM (SELECT unnest(range(DATE '1995-01-01', DATE '2002-01-01', INTERVAL 1 MONTH)) AS m)) d ON date_added <= d.date AND (date_removed IS NULL OR date_removed > d.date)")
def jon14(spark, d):
    dates = spark.sql("select last_day(m) as date from (select explode(sequence(date '1995-01-01', date '2001-12-01', interval 1 month)) as m)")
    return J.members_by_date(_intervals(spark, d), dates)


@query("jon15", sql("SELECT a.date, a.ret AS x, b.ret AS y, c.ret AS z FROM returns a JOIN returns b USING (date) JOIN returns c USING (date) WHERE a.series_id = 'Brand#1' AND b.series_id = 'Brand#2' AND c.series_id = 'Brand#3'", "returns"))
def jon15(spark, d):
    r = returns(spark, d)
    one = lambda t, n: r.where(F.col("series_id") == t).select("date", F.col("ret").alias(n))
    return one("Brand#1", "x").join(one("Brand#2", "y"), "date").join(one("Brand#3", "z"), "date")


@query("jon16", sql("SELECT a.date, a.ret AS x, b.ret AS y FROM returns a JOIN returns b USING (date) WHERE a.series_id = 'Brand#1' AND b.series_id = 'Brand#2'", "returns"))
def jon16(spark, d):
    r = returns(spark, d)
    one = lambda t, n: r.where(F.col("series_id") == t).select("date", F.col("ret").alias(n))
    return one("Brand#1", "x").join(one("Brand#2", "y"), "date", "full_outer").dropna()


_SEMI = "SELECT o_orderkey FROM orders o WHERE {} EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')"


@query("jon17", _SEMI.format(""))
def jon17(spark, d):
    back = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    o = table(spark, d, "orders")
    return o.join(back, o["o_orderkey"] == back["l_orderkey"], "left_semi").select("o_orderkey")


@query("jon18", _SEMI.format("NOT"))
def jon18(spark, d):
    back = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    o = table(spark, d, "orders")
    return o.join(back, o["o_orderkey"] == back["l_orderkey"], "left_anti").select("o_orderkey")


@query("jon20", sql("", "bars").rstrip() + ", m AS (SELECT date, avg(close / open - 1) AS mkt FROM bars GROUP BY date) SELECT ticker, date, ROUND(close / open - 1 - mkt, 6) AS excess FROM bars JOIN m USING (date)")
def jon20(spark, d):
    b = bars(spark, d)
    m = b.groupBy("date").agg(F.avg(F.col("close") / F.col("open") - 1).alias("mkt"))
    return b.join(F.broadcast(m), "date", "left").select("ticker", "date", F.round(change(F.col("close"), F.col("open")) - F.col("mkt"), 6).alias("excess"))


@query("jon21", "SELECT n_name, CAST(o_orderdate AS DATE) AS date, min(o_custkey) AS first_key FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def jon21(spark, d):
    """Lookup of the issuer, then one row of those that share it on a day."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    r = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("date", F.to_date("o_orderdate"))
    return J.newest(r.select("n_name", "date", "o_custkey", "o_orderkey"), ["n_name", "date"], [F.col("o_custkey"), F.col("o_orderkey")]).select("n_name", "date", F.col("o_custkey").alias("first_key"))


@query("set01", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def set01(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("set02", sql("SELECT date, coalesce(b.ret, a.ret) AS ret FROM (SELECT date, ret FROM returns WHERE series_id = 'Brand#1') a FULL JOIN (SELECT date, ret FROM returns WHERE series_id = 'Brand#2') b USING (date)", "returns"))
def set02(spark, d):
    """Union where the later source wins."""
    r = returns(spark, d)
    both = r.where("series_id in ('Brand#1', 'Brand#2')").select("date", "ret", F.when(F.col("series_id") == "Brand#2", 0).otherwise(1).alias("p"))
    return J.newest(both, ["date"], [F.col("p")]).select("date", "ret")


@query("set03", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set03(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("set04", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set04(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).subtract(table(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("set05", "SELECT DISTINCT p_type FROM part ORDER BY 1")
def set05(spark, d):
    return table(spark, d, "part").select("p_type").distinct().orderBy("p_type")
