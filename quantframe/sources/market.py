"""Domain inputs derived from the shared tables, and the scans that read them.

Each has a DataFrame form here and, for checks, the same derivation as a CTE in `CTES`.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: the held-out window
HOLDOUT = (date(2000, 5, 21), date(2001, 5, 21))

_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: ticker (brand), date, open, high, low, close (first and last trade in a total order), volume."""
    trades = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    px, order = F.col("l_extendedprice") / F.col("l_quantity"), F.struct(*_ORDER)
    return trades.groupBy(F.col("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(
        F.min_by(px, order).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, order).alias("close"), F.sum("l_quantity").alias("volume")
    )


def brand_of(number):
    """One of the 25 brands for any whole number."""
    return F.concat(F.lit("Brand#"), (F.pmod(number, F.lit(25)) + 1).cast("string"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report calendar: ticker, date, time (bmo, amc or empty), actual, estimate; the first order of a (ticker, date) counts."""
    o = table(spark, sf_dir, "orders")
    raw = o.select(
        brand_of(F.col("o_custkey")).alias("ticker"), F.to_date("o_orderdate").alias("date"), "o_orderkey",
        F.when(F.col("o_orderpriority").startswith("1"), "bmo").when(F.col("o_orderpriority").startswith("2"), "amc").otherwise("").alias("time"),
        F.col("o_totalprice").alias("actual"), (F.col("o_totalprice") * (1 + (F.col("o_orderkey") % 21 - 10) / 100)).alias("estimate"),
    )
    first = Window.partitionBy("ticker", "date").orderBy("o_orderkey", "actual")
    return raw.withColumn("k", F.row_number().over(first)).where("k = 1").select("ticker", "date", "time", "actual", "estimate")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly facts by filing: ticker, period_date, filing_date, roe, margin, leverage; some periods are filed twice."""
    o = table(spark, sf_dir, "orders").withColumn("ticker", brand_of(F.col("o_custkey"))).withColumn("period_date", F.last_day(F.add_months(F.date_trunc("quarter", "o_orderdate").cast("date"), 2)))
    q = o.groupBy("ticker", "period_date").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"), F.min("o_totalprice").alias("bottom"), F.max("o_orderkey").alias("k")
    )
    late = F.array(F.lit(30) + F.col("k") % 60, F.when(F.col("k") % 5 == 0, F.lit(200) + F.col("k") % 90))
    rows = q.select("ticker", "period_date", F.explode(F.array_compact(late)).alias("lag"), "n", "top", "bottom")
    return rows.select("ticker", "period_date", F.date_add("period_date", F.col("lag").cast("int")).alias("filing_date"), (F.col("bottom") / F.col("top")).alias("roe"), (F.col("n") / F.col("top")).alias("margin"), (F.col("top") - F.col("bottom")).alias("leverage"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly macro series with gaps: date (month begin), a, b."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("date")).agg(F.max("l_discount").alias("d"), F.count(F.lit(1)).alias("n"), F.max("l_extendedprice").alias("p"))
    return m.select("date", F.when(F.month("date") % 3 != 0, F.col("p")).alias("a"), F.when(F.month("date") % 4 != 0, F.col("n").cast("double")).alias("b"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tick stream: ticker (event type), ts, price, size."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("ticker"), "ts", "event_id", F.col("value").alias("price"), F.lit(1.0).alias("size"))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return series: series_id, date, ret (bar to bar, first bar left out)."""
    w = Window.partitionBy("ticker").orderBy("date")
    b = bars(spark, sf_dir).withColumn("ret", F.col("close") / F.lag("close").over(w) - 1)
    return b.where("ret is not null").select(F.col("ticker").alias("series_id"), "date", (F.greatest(F.least("ret", F.lit(0.5)), F.lit(-0.5)) / 10).alias("ret"))


def check_holdout(start: date, end: date, window: tuple[date, date] = HOLDOUT) -> None:
    """Refuse a read that overlaps the held-out window (both ends inclusive)."""
    if start <= window[1] and end >= window[0]:
        raise PermissionError(f"{start}..{end} overlaps the held-out window {window[0]}..{window[1]}")


def read_bars(spark: SparkSession, sf_dir: str, tickers: list[str] | None, start: date, end: date, guard: bool = True) -> DataFrame:
    """Bars of some tickers in a closed date range, sorted; with guard a read of the held-out window raises before a plan is built."""
    if guard:
        check_holdout(start, end)
    b = bars(spark, sf_dir).where(F.col("date").between(F.lit(start), F.lit(end)))
    return (b.where(F.col("ticker").isin(tickers)) if tickers else b).orderBy("date", "ticker")


_BARS = """bars AS (
    SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date,
           first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS open,
           max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
           last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS close,
           sum(l_quantity) AS volume
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
_BRAND = "'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR)"

CTES = {
    "bars": _BARS,
    "reports": f"""reports AS (
    SELECT ticker, date, time, actual, estimate FROM (
        SELECT {_BRAND} AS ticker, CAST(o_orderdate AS DATE) AS date,
               CASE WHEN o_orderpriority LIKE '1%' THEN 'bmo' WHEN o_orderpriority LIKE '2%' THEN 'amc' ELSE '' END AS time,
               o_totalprice AS actual, o_totalprice * (1 + (o_orderkey % 21 - 10) / 100) AS estimate,
               row_number() OVER (PARTITION BY {_BRAND}, CAST(o_orderdate AS DATE) ORDER BY o_orderkey, o_totalprice) AS k
        FROM orders) WHERE k = 1)""",
    "filings": f"""quarters AS (
    SELECT {_BRAND} AS ticker, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS period_date,
           count(*) AS n, max(o_totalprice) AS top, min(o_totalprice) AS bottom, max(o_orderkey) AS k
    FROM orders GROUP BY 1, 2),
    filings AS (
    SELECT ticker, period_date, CAST(period_date + CAST(lag_days AS INTEGER) AS DATE) AS filing_date, bottom / top AS roe, n / top AS margin, top - bottom AS leverage
    FROM (SELECT *, 30 + k % 60 AS lag_days FROM quarters UNION ALL SELECT *, 200 + k % 90 FROM quarters WHERE k % 5 = 0))""",
    "macro": """macro AS (
    SELECT date, CASE WHEN month(date) % 3 <> 0 THEN p END AS a, CASE WHEN month(date) % 4 <> 0 THEN CAST(n AS DOUBLE) END AS b FROM (
        SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, count(*) AS n, max(l_extendedprice) AS p FROM lineitem GROUP BY 1))""",
    "ticks": "ticks AS (SELECT event_type AS ticker, ts, event_id, value AS price, CAST(1.0 AS DOUBLE) AS size FROM events)",
    "returns": """returns AS (
    SELECT ticker AS series_id, date, greatest(least(r, 0.5), -0.5) / 10 AS ret
    FROM (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM bars) WHERE r IS NOT NULL)""",
    "calendar": "calendar AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM bars))",
    "book": "book AS (SELECT date, avg(ret) AS b FROM returns GROUP BY date)",
}
_NEEDS = {"returns": ["bars"], "calendar": ["bars"], "book": ["returns", "bars"]}


def sql(body: str, *names: str) -> str:
    """body behind the named CTEs and what they need."""
    order: list[str] = []
    for n in names:
        for x in (*reversed(_NEEDS.get(n, [])), n):
            if x not in order:
                order.append(x)
    return "WITH " + ", ".join(CTES[n] for n in order) + "\n" + body if order else body
