"""Aggregation, cleaning and top-k queries (AGG, PRJ, TOP)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import surprise
from ..operators import bars as B
from ..operators import clean as C
from ..operators import joins as J
from ..operators import stats as S
from ..operators import windows as W
from ..sources.market import bars, macro, reports, returns, sql, table, ticks
from .registry import query

T = "OVER (PARTITION BY ticker ORDER BY date)"


@query("agg01", sql("SELECT ticker, ROUND(avg(close * volume), 2) AS adtv FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars) WHERE k <= 63 GROUP BY ticker", "bars"))
def agg01(spark, d):
    return B.adtv(bars(spark, d)).select("ticker", F.round("adtv", 2).alias("adtv"))


TICK_BARS = (
    "WITH RECURSIVE " + sql("", "ticks").removeprefix("WITH ").rstrip() + """,
    t AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts, price) AS k FROM ticks WHERE price IS NOT NULL),
    walk AS (
        SELECT ticker, k, ts, price AS o, price AS h, price AS l, price AS c, size AS v, price * size AS dv FROM t WHERE k = 1
        UNION ALL
        SELECT t.ticker, t.k, CASE WHEN dv >= 2000 THEN t.ts ELSE w.ts END, CASE WHEN dv >= 2000 THEN t.price ELSE o END, CASE WHEN dv >= 2000 THEN t.price ELSE greatest(h, t.price) END,
               CASE WHEN dv >= 2000 THEN t.price ELSE least(l, t.price) END, t.price, CASE WHEN dv >= 2000 THEN t.size ELSE v + t.size END, CASE WHEN dv >= 2000 THEN t.price * t.size ELSE dv + t.price * t.size END
        FROM walk w JOIN t ON t.ticker = w.ticker AND t.k = w.k + 1)
    SELECT ticker, ts, o AS open, h AS high, l AS low, c AS close, v AS volume, ROUND(dv, 4) AS dollar_volume FROM walk WHERE dv >= 2000"""
)


@query("agg02", TICK_BARS)
def agg02(spark, d):
    t = ticks(spark, d)
    limit = t.select("ticker").distinct().withColumn("threshold", F.lit(2000.0))
    return B.dollar_bars(t, limit, doubles=True).withColumn("dollar_volume", F.round("dollar_volume", 4))


@query("agg03", sql("SELECT ticker, date, open, high, low, close, volume, close * volume AS dollar_volume FROM bars", "bars"))
def agg03(spark, d):
    return bars(spark, d).withColumn("dollar_volume", F.col("close") * F.col("volume"))


_PREV = "(SELECT b.*, p.open AS prev FROM (SELECT * FROM bars JOIN calendar USING (date)) b LEFT JOIN (SELECT ticker, idx, open FROM bars JOIN calendar USING (date)) p ON p.ticker = b.ticker AND p.idx = b.idx - 1)"


@query("agg04", sql(f"SELECT date, ROUND(avg(open / prev - 1), 6) AS ret FROM {_PREV} WHERE prev >= 5 GROUP BY date", "bars", "calendar"))
def agg04(spark, d):
    return B.equal_weight_benchmark(bars(spark, d)).select("date", F.round("ret", 6).alias("ret"))


@query("agg05", sql(f"SELECT date, ROUND(avg(close / open - 1), 6) AS ret FROM {_PREV} WHERE prev >= 5 GROUP BY date", "bars", "calendar"))
def agg05(spark, d):
    p = W.lag_calendar(bars(spark, d), "open", 1, "p")
    return p.where("p >= 5").groupBy("date").agg(F.round(F.avg(F.col("close") / F.col("open") - 1), 6).alias("ret"))


@query("agg06", sql("SELECT date, ROUND(avg(ret), 8) AS ret FROM returns GROUP BY date", "returns"))
def agg06(spark, d):
    return returns(spark, d).groupBy("date").agg(F.round(F.avg("ret"), 8).alias("ret"))


@query("agg07", sql("SELECT series_id, count(*) FILTER (WHERE abs(ret) > 0.01) AS active_days, ROUND(avg(CASE WHEN abs(ret) > 0.01 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM returns GROUP BY 1", "returns"))
def agg07(spark, d):
    on = F.abs("ret") > 0.01
    return returns(spark, d).groupBy("series_id").agg(F.count_if(on).alias("active_days"), F.round(F.avg(on.cast("double")), 6).alias("rate"))


@query("agg08", sql("SELECT date, ROUND(avg(ret), 8) AS ret, count(*) AS n FROM returns WHERE series_id IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY 1", "returns"))
def agg08(spark, d):
    """Equal-weight combination over the series that have the date."""
    r = returns(spark, d).where("series_id in ('Brand#1', 'Brand#2', 'Brand#3')")
    return r.groupBy("date").agg(F.round(F.avg("ret"), 8).alias("ret"), F.count(F.lit(1)).alias("n"))


_WGT = "CAST(substr(series_id, 7) AS DOUBLE)"


@query("agg09", sql(f"SELECT date, ROUND(sum({_WGT} * ret) / 325, 8) AS ret FROM returns GROUP BY 1", "returns"))
def agg09(spark, d):
    """Weighted combination over the weight of all series: one without the date counts 0."""
    r = returns(spark, d).withColumn("w", F.substring("series_id", 7, 2).cast("double"))
    total = r.select("series_id", "w").distinct().agg(F.sum("w").alias("t"))
    return r.groupBy("date").agg(F.sum(F.col("w") * F.col("ret")).alias("s")).crossJoin(F.broadcast(total)).select("date", F.round(F.col("s") / F.col("t"), 8).alias("ret"))


@query("agg10", "SELECT event_type, floor(value / 20) AS bucket, count(*) AS n, ROUND(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def agg10(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type", F.floor(F.col("value") / 20).cast("double").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("agg11", "SELECT l_returnflag, ROUND(corr(l_quantity, l_extendedprice), 6) AS price, ROUND(corr(l_quantity, l_discount), 6) AS discount, ROUND(corr(l_quantity, l_tax), 6) AS tax FROM lineitem GROUP BY 1")
def agg11(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    return l.groupBy("l_returnflag").agg(*[F.round(F.corr("l_quantity", c), 6).alias(n) for c, n in (("l_extendedprice", "price"), ("l_discount", "discount"), ("l_tax", "tax"))])


@query("agg12", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P, ROUND(avg(CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.0 END), 6) AS share FROM orders GROUP BY 1")
def agg12(spark, d):
    """Decision matrix, and the share of matches."""
    o = table(spark, d, "orders")
    m = o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    s = o.groupBy("o_orderpriority").agg(F.round(F.avg((F.col("o_totalprice") > 200000).cast("double")), 6).alias("share"))
    return m.join(s, "o_orderpriority")


@query("agg13", sql("SELECT date, unnest(['Brand#1', 'Brand#2']) AS ticker, unnest([max(CASE WHEN ticker = 'Brand#1' THEN close END), max(CASE WHEN ticker = 'Brand#2' THEN close END)]) AS close FROM bars GROUP BY date", "bars"))
def agg13(spark, d):
    """Pivot to date x ticker and back; gaps become NULL rows."""
    p = bars(spark, d).groupBy("date").pivot("ticker", ["Brand#1", "Brand#2"]).agg(F.first("close"))
    return p.unpivot("date", ["Brand#1", "Brand#2"], "ticker", "close")


@query("agg14", sql("SELECT ROUND(avg(CASE WHEN a IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS a, ROUND(avg(CASE WHEN b IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS b FROM macro", "macro"))
def agg14(spark, d):
    return macro(spark, d).agg(*[F.round(F.avg(F.col(c).isNotNull().cast("double")), 6).alias(c) for c in ("a", "b")])


@query("agg15", sql("SELECT ticker, min(date) AS first_day, max(date) AS last_day, count(DISTINCT date) AS days FROM bars GROUP BY 1", "bars"))
def agg15(spark, d):
    return bars(spark, d).groupBy("ticker").agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.countDistinct("date").alias("days"))


@query("agg16", sql("SELECT year(date) AS y, last(a ORDER BY date) FILTER (WHERE a IS NOT NULL) AS a, last(b ORDER BY date) FILTER (WHERE b IS NOT NULL) AS b FROM macro GROUP BY 1", "macro"))
def agg16(spark, d):
    """Last known value of each column of a group."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c)
    return macro(spark, d).groupBy(F.year("date").cast("long").alias("y")).agg(last("a"), last("b"))


_P = "quantile_cont(o_totalprice, {})"


@query("agg17", f"SELECT o_orderpriority, ROUND({_P.format('0.1::DOUBLE')}, 3) AS p10, ROUND({_P.format('0.5::DOUBLE')}, 3) AS p50, ROUND({_P.format('0.9::DOUBLE')}, 3) AS p90, max(o_totalprice) AS top FROM orders GROUP BY 1")
def agg17(spark, d):
    o = table(spark, d, "orders")
    p = S.group_quantiles(o, "o_orderpriority", "o_totalprice", [0.1, 0.5, 0.9])
    return p.select("o_orderpriority", *[F.round(F.col("values")[k], 3).alias(n) for k, n in enumerate(("p10", "p50", "p90"))], F.col("most").alias("top"))


@query("agg18", "SELECT n_regionkey, ROUND(avg(coalesce(s.w, 1)), 6) AS weight FROM nation LEFT JOIN (SELECT s_nationkey, avg(s_acctbal) / 1000 AS w FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON s_nationkey = n_nationkey GROUP BY 1")
def agg18(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg((F.avg("s_acctbal") / 1000).alias("w"))
    n = table(spark, d, "nation")
    return n.join(s, n["n_nationkey"] == s["s_nationkey"], "left").groupBy("n_regionkey").agg(F.round(F.avg(F.coalesce("w", F.lit(1.0))), 6).alias("weight"))


@query("agg20", "SELECT max(o_orderkey) AS top, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open FROM orders")
def agg20(spark, d):
    return table(spark, d, "orders").agg(F.max("o_orderkey").alias("top"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"))


@query("agg21", "SELECT role, CAST(sum(length(text)) AS BIGINT) AS chars, sum(length(text)) / 4.0 AS tokens FROM conversations GROUP BY 1")
def agg21(spark, d):
    c = table(spark, d, "conversations").groupBy("role").agg(F.sum(F.length("text")).alias("chars"))
    return c.withColumn("tokens", F.col("chars") / 4.0)


# --- projections and filters ---


@query("prj01", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def prj01(spark, d):
    return table(spark, d, "orders").where("o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01'").select("o_orderkey")


@query("prj02", "SELECT CAST(o_orderdate AS DATE) AS date, CAST(o_orderdate AS DATE) <= DATE '2001-05-21' AND CAST(o_orderdate AS DATE) + 30 >= DATE '2000-05-21' AS overlaps FROM orders GROUP BY 1")
def prj02(spark, d):
    """Whether a read of 30 days from each date would touch the held-out window (the guard itself is `check_holdout`)."""
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return days.withColumn("overlaps", (F.col("date") <= F.lit("2001-05-21").cast("date")) & (F.date_add("date", 30) >= F.lit("2000-05-21").cast("date")))


@query("prj03", sql("SELECT CASE WHEN date < DATE '2000-05-21' THEN 'train' WHEN date <= DATE '2001-05-21' THEN 'holdout' ELSE 'after' END AS part, count(*) AS n FROM bars GROUP BY 1", "bars"))
def prj03(spark, d):
    part = F.when(F.col("date") < "2000-05-21", "train").when(F.col("date") <= "2001-05-21", "holdout").otherwise("after")
    return bars(spark, d).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


_NULLS = ", ".join(f"CAST(NULL AS {'VARCHAR' if c == 'sector' else 'DOUBLE'}) AS {c}" for c in C.PANEL_COLUMNS[5:])


@query("prj04", sql(f"SELECT date, ticker, open, high, low, close, volume, {_NULLS} FROM bars", "bars"))
def prj04(spark, d):
    return C.conform(bars(spark, d))


@query("prj05", sql("SELECT date, a, b FROM macro WHERE a IS NOT NULL AND b IS NOT NULL", "macro"))
def prj05(spark, d):
    return macro(spark, d).dropna(subset=["a", "b"])


@query("prj06", sql("SELECT ticker, date, ROUND((actual - estimate) / nullif(abs(estimate), 0), 6) AS surprise FROM reports", "reports"))
def prj06(spark, d):
    return reports(spark, d).select("ticker", "date", F.round(surprise("actual", "estimate"), 6).alias("surprise"))


@query("prj07", "SELECT p_partkey, TRY_CAST(split_part(p_name, ' ', 2) AS DOUBLE) AS a, TRY_CAST(substr(p_brand, 7) AS DOUBLE) AS b FROM part")
def prj07(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", "split_part(p_name, ' ', 2) as x", "substr(p_brand, 7) as y").select("p_partkey", C.number("x").alias("a"), C.number("y").alias("b"))


@query("prj08", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_key FROM orders GROUP BY 1")
def prj08(spark, d):
    o = table(spark, d, "orders")
    a = C.keep_one(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("first_key"))
    b = C.keep_one(o, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", F.col("o_orderkey").alias("last_key"))
    return a.join(b, "o_custkey")


@query("prj09", sql(f"SELECT ticker, date, open FROM (SELECT *, lag(open) {T} AS p FROM bars) WHERE open >= 5000 AND p >= 5000", "bars"))
def prj09(spark, d):
    """Price floors on this bar and the one before."""
    return bars(spark, d).withColumn("p", W.lag("open")).where("open >= 5000 and p >= 5000").select("ticker", "date", "open")


@query("prj11", "SELECT o_orderkey FROM orders WHERE coalesce(nullif(o_totalprice, 0), o_orderkey) > 150000 AND o_orderkey % 3 > 0")
def prj11(spark, d):
    """Beat predicate with a fallback for a missing or zero first column."""
    return table(spark, d, "orders").where((F.coalesce(F.nullif("o_totalprice", F.lit(0.0)), "o_orderkey") > 150000) & (F.col("o_orderkey") % 3 > 0)).select("o_orderkey")


@query("prj12", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\\b(the|results?)\\b.*\\b(and|quarter)\\b') AND NOT regexp_matches(text, '(?i)\\b(schedule|conference|with)\\b')")
def prj12(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where(t.rlike(r"(?i)\b(the|results?)\b.*\b(and|quarter)\b") & ~t.rlike(r"(?i)\b(schedule|conference|with)\b")).select("doc_id")


@query("prj14", "SELECT event_id, CASE WHEN value >= 80 THEN 'high' WHEN value >= 20 THEN 'middle' ELSE 'low' END AS bucket FROM events WHERE event_type <> 'view'")
def prj14(spark, d):
    b = F.when(F.col("value") >= 80, "high").when(F.col("value") >= 20, "middle").otherwise("low")
    return table(spark, d, "events").where("event_type <> 'view'").select("event_id", b.alias("bucket"))


@query("prj15", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 600")
def prj15(spark, d):
    kept = C.at_least_rows(table(spark, d, "lineitem").select("l_suppkey"), "l_suppkey", 600)
    return kept.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("prj17", "SELECT doc_id, CAST(NULL AS DOUBLE) AS sentiment_score FROM documents")
def prj17(spark, d):
    return table(spark, d, "documents").select("doc_id", F.lit(None).cast("double").alias("sentiment_score"))


@query("prj18", "SELECT page_id, regexp_replace(url || '?apikey=' || page_id || '&x=1', '(?i)apikey=[^&\\s]+', 'apikey=***', 'g') AS url FROM pages")
def prj18(spark, d):
    return table(spark, d, "pages").select("page_id", C.redact(F.concat("url", F.lit("?apikey="), "page_id", F.lit("&x=1"))).alias("url"))


# --- top-k ---


@query("top01", sql("SELECT ticker, date, close FROM bars ORDER BY ticker, date", "bars"))
def top01(spark, d):
    return bars(spark, d).select("ticker", "date", "close").orderBy("ticker", "date")


@query("top02", sql("SELECT date, ticker, ROUND(1.0 / count(*) OVER (PARTITION BY date), 6) AS weight FROM (SELECT *, quantile_cont(volume, 0.8::DOUBLE) OVER (PARTITION BY date) AS q, count(*) OVER (PARTITION BY date) AS n FROM bars) WHERE n >= 5 AND volume >= q", "bars"))
def top02(spark, d):
    return C.top_quantile(bars(spark, d), "volume", ["date"]).select("date", "ticker", F.round("weight", 6).alias("weight"))


@query("top03", sql("SELECT date, ticker FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY volume DESC, ticker) AS k, count(*) OVER (PARTITION BY date) AS n FROM bars) WHERE k <= greatest(1, floor(n * 0.1))", "bars"))
def top03(spark, d):
    return C.top_share(bars(spark, d), "volume", ["date"], ["ticker"]).select("date", "ticker")


@query("top04", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 3")
def top04(spark, d):
    return J.newest(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.col("n_chars").desc(), F.col("doc_id")], 3).select("source", "doc_id")


@query("top05", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def top05(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'O'").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(1).select("o_orderkey", "o_totalprice")


@query("top08", sql("SELECT ticker, max(date) AS date, arg_max(close, date) AS close FROM bars GROUP BY 1", "bars"))
def top08(spark, d):
    return bars(spark, d).groupBy("ticker").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))


