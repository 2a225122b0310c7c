"""Scan, sink and text queries (SRC, SNK, PRJ16)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import windows as W
from ..sources import files, market, paged
from ..sources.market import bars, filings, macro, reports, sql, table
from .registry import query


@query("src01", sql("SELECT ticker, date, close FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'", "bars"))
def src01(spark, d):
    return market.read_bars(spark, d, None, date(1996, 1, 1), date(1997, 12, 31)).select("ticker", "date", "close")


@query("src02", sql("SELECT ticker, date, close FROM bars WHERE ticker IN ('Brand#1', 'Brand#7') ORDER BY date, ticker", "bars"))
def src02(spark, d):
    return market.read_bars(spark, d, ["Brand#1", "Brand#7"], date(1990, 1, 1), date(2010, 1, 1), guard=False).select("ticker", "date", "close")


@query("src03", sql("SELECT date, count(*) AS names FROM bars GROUP BY 1 ORDER BY 1", "bars"))
def src03(spark, d):
    """Bar replay as cross-sections: how many names each holds, in order."""
    return bars(spark, d).groupBy("date").agg(F.count(F.lit(1)).alias("names")).orderBy("date")


@query("src04", sql("SELECT ticker, max(date) AS date, arg_max(close, date) AS close FROM bars GROUP BY 1", "bars"))
def src04(spark, d):
    return bars(spark, d).groupBy("ticker").agg(F.max_by(F.struct("date", "close"), "date").alias("x")).select("ticker", "x.date", "x.close")


@query("src05", sql("SELECT ticker, date, open, high, low, close, volume FROM bars WHERE ticker = 'Brand#9' AND date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'", "bars"))
def src05(spark, d):
    return market.read_bars(spark, d, ["Brand#9"], date(1998, 1, 1), date(1998, 12, 31)).select("ticker", "date", "open", "high", "low", "close", "volume")


@query("src06", sql("SELECT ticker, date, actual FROM reports WHERE date >= DATE '1998-01-01' AND date < DATE '1999-01-01'", "reports"))
def src06(spark, d):
    return reports(spark, d).where("date >= date '1998-01-01' and date < date '1999-01-01'").select("ticker", "date", "actual")


@query("src07", sql("SELECT ticker, date, estimate FROM reports", "reports"))
def src07(spark, d):
    return reports(spark, d).select("ticker", "date", "estimate")


_A = "SELECT ticker, period_date, max(roe) AS roe FROM filings GROUP BY 1, 2"
_B = "SELECT ticker, period_date, max(leverage) AS ev FROM filings WHERE month(period_date) <> 6 GROUP BY 1, 2"


def _sides(spark, d):
    f = filings(spark, d)
    a = f.groupBy("ticker", "period_date").agg(F.max("roe").alias("roe"))
    return a, f.where("month(period_date) <> 6").groupBy("ticker", "period_date").agg(F.max("leverage").alias("ev"))


@query("src08", sql(f"SELECT ticker, period_date, ROUND(roe, 9) AS roe, ROUND(ev, 4) AS ev FROM ({_A}) LEFT JOIN ({_B}) USING (ticker, period_date)", "filings"))
def src08(spark, d):
    a, b = _sides(spark, d)
    return a.join(b, ["ticker", "period_date"], "left").select("ticker", "period_date", F.round("roe", 9).alias("roe"), F.round("ev", 4).alias("ev"))


@query("src09", sql(f"SELECT ticker, period_date, ROUND(roe / nullif(ev, 0), 12) AS ratio FROM ({_A}) JOIN ({_B}) USING (ticker, period_date)", "filings"))
def src09(spark, d):
    a, b = _sides(spark, d)
    return a.join(b, ["ticker", "period_date"]).select("ticker", "period_date", F.round(F.try_divide("roe", F.nullif("ev", F.lit(0.0))), 12).alias("ratio"))


@query("src10", "SELECT source, lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1, 2")
def src10(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("src11", "SELECT event_type, date_trunc('second', ts) AS ts, value AS open, value + 1 AS close FROM events")
def src11(spark, d):
    """Minute bars of a paged service: pages of a thousand results, each naming the next, read back by chains."""
    one = F.lit(1.0)
    e = table(spark, d, "events").select(F.col("event_type").alias("ticker"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"), *[F.col("value").alias(x) for x in ("open", "high", "low")], (F.col("value") + 1).alias("close"), one.alias("volume"))
    path = files.work_dir(spark, "pages")
    paged.write_pages(e, path)
    at = F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("yyyy-MM-dd HH:mm:ss.SSS"))
    return paged.read_pages(spark, path).select(F.col("ticker").alias("event_type"), at.alias("ts"), "open", "close")


@query("src12", sql("SELECT ticker, date, time, actual, estimate FROM reports", "reports"))
def src12(spark, d):
    return reports(spark, d)


@query("src13", sql("SELECT date, ticker AS etf, close FROM bars WHERE ticker IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#5')", "bars"))
def src13(spark, d):
    return bars(spark, d).where("ticker in ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#5')").select("date", F.col("ticker").alias("etf"), "close")


@query("src14", sql(f"SELECT ticker, period_date, coalesce(f.filing_date, CAST(period_date + 90 AS DATE)) AS filing_date, ROUND(roe, 9) AS roe, ROUND(ev, 4) AS ev FROM ({_A}) FULL JOIN ({_B}) USING (ticker, period_date) LEFT JOIN (SELECT ticker, period_date, min(filing_date) AS filing_date FROM filings WHERE month(period_date) <> 9 GROUP BY 1, 2) f USING (ticker, period_date)", "filings"))
def src14(spark, d):
    """Quarterly facts of several sources joined in full; a filing date that is missing is taken 90 days after the period."""
    a, b = _sides(spark, d)
    f = filings(spark, d).where("month(period_date) <> 9").groupBy("ticker", "period_date").agg(F.min("filing_date").alias("filing_date"))
    j = a.join(b, ["ticker", "period_date"], "full_outer").join(f, ["ticker", "period_date"], "left")
    return j.select("ticker", "period_date", F.coalesce("filing_date", F.date_add("period_date", 90)).alias("filing_date"), F.round("roe", 9).alias("roe"), F.round("ev", 4).alias("ev"))


@query("src16", sql("SELECT date, a / 100 AS a, b / 100 AS b FROM macro", "macro"))
def src16(spark, d):
    """Factors in percent to shares."""
    return macro(spark, d).select("date", (F.col("a") / 100).alias("a"), (F.col("b") / 100).alias("b"))


@query("src17", sql("SELECT date, a FROM macro WHERE date >= DATE '1996-01-01' AND date < DATE '1999-01-01'", "macro"))
def src17(spark, d):
    """Through the CSV form, in which a dot is no value; the end of the window is exclusive."""
    m = macro(spark, d).select(F.concat_ws(",", F.col("date").cast("string"), F.coalesce(F.col("a").cast("string"), F.lit("."))).alias("line"))
    r = m.select(F.from_csv("line", "date date, a double", {"nullValue": "."}).alias("x")).select("x.*")
    return r.where("date >= date '1996-01-01' and date < date '1999-01-01'")


@query("src18", sql("SELECT date, close FROM bars WHERE ticker = 'Brand#1'", "bars"))
def src18(spark, d):
    return bars(spark, d).where("ticker = 'Brand#1'").select("date", "close")


@query("src19", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_type ELSE 'Unknown' END AS sector FROM part")
def src19(spark, d):
    """Sector out of JSON with a default."""
    p = table(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.when(F.col("p_size") > 25, F.col("p_type")).alias("sector"))).alias("body"))
    return p.select("p_partkey", F.coalesce(F.get_json_object("body", "$.sector"), F.lit("Unknown")).alias("sector"))


@query("src20", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey IN (3, 5, 8) AND l_quantity BETWEEN 10 AND 20")
def src20(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag = 'A' and l_suppkey in (3, 5, 8) and l_quantity between 10 and 20").select("l_orderkey", "l_extendedprice")


@query("src21", "SELECT o_orderkey, o_totalprice * CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 2 ELSE 1 END AS price FROM orders")
def src21(spark, d):
    """Two files with an overlap, the later one winning."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), "o_orderdate")
    late = o.where("o_orderdate >= '1998-01-01'").withColumn("price", F.col("price") * 2)
    return files.merge_keep_last(o, late, ["o_orderkey"]).select("o_orderkey", "price")


@query("src22")
def src22(spark, d):
    """A sampling operator: 400 names by seeded hash, the same on every run."""
    return files.sample_names(table(spark, d, "customer").select("c_custkey"), "c_custkey")


@query("src24", "SELECT o_custkey AS cik, o_orderkey AS accession FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderstatus = 'O'")
def src24(spark, d):
    """Parallel arrays of a filing index as rows."""
    o = table(spark, d, "orders")
    arrays = o.groupBy(F.col("o_custkey").alias("cik")).agg(F.collect_list(F.struct(F.when(F.col("o_orderstatus") == "O", "8-K").otherwise("10-Q").alias("form"), F.when(F.col("o_orderpriority").startswith("1"), "2.02,9.01").otherwise("9.01").alias("items"), F.col("o_orderkey").alias("accession"), F.col("o_orderdate").alias("accepted"))).alias("r"))
    arrays = arrays.select("cik", *[F.col(f"r.{c}").alias(c) for c in ("form", "items", "accession", "accepted")])
    return files.zip_filings(arrays).select("cik", "accession")


@query("src25")
def src25(spark, d):
    """Filings with headers that list their documents: the first EX-99 exhibit of each is chosen by its header, and its page's visible text taken."""
    files.small_batches(spark)
    p = table(spark, d, "pages")
    part = lambda kind, name: F.concat(F.lit("&lt;DOCUMENT&gt;\n&lt;TYPE&gt;"), F.lit(kind), F.lit("\n&lt;SEQUENCE&gt;1\n&lt;FILENAME&gt;"), name, F.lit("\n&lt;DESCRIPTION&gt;x\n"))
    page = F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".htm"))
    graphic, chart = part("GRAPHIC", F.lit("logo.jpg")), part("EX-10", F.lit("plan.htm"))
    before = F.when(F.col("page_id") % 3 == 0, graphic).when(F.col("page_id") % 3 == 1, chart).otherwise(F.lit(""))
    header = F.concat(part("8-K", F.lit("main.htm")), before, F.when(F.col("page_id") % 2 == 0, part("ex-99.1", page)).otherwise(part("EX-99", page)), part("EX-99.2", F.lit("other.htm")))
    listed = p.select("page_id", header.alias("headers")).select("page_id", files.first_exhibit("headers").alias("exhibit"))
    found = listed.join(p.select(page.alias("name"), "html"), F.col("exhibit") == F.col("name"), "left")
    return found.select("page_id", "exhibit", files.html_text("html").alias("text"))


@query("src26", "SELECT c_custkey FROM customer WHERE c_acctbal >= 1000 AND c_mktsegment <> 'BUILDING'")
def src26(spark, d):
    return table(spark, d, "customer").where("c_acctbal >= 1000 and c_mktsegment <> 'BUILDING'").select("c_custkey")


@query(
    "src29",
    sql("", "bars").rstrip()
    + """, months AS (SELECT DISTINCT date_trunc('month', date)::DATE AS m FROM bars),
    held AS (SELECT DISTINCT ticker, date_trunc('month', date)::DATE AS m FROM bars WHERE NOT (ticker IN ('Brand#3', 'Brand#8') AND date BETWEEN DATE '1998-03-01' AND DATE '1998-03-31'))
    SELECT ticker, m AS missing FROM (SELECT DISTINCT ticker FROM held), months EXCEPT SELECT ticker, m FROM held""",
)
def src29(spark, d):
    """Months that each ticker's cache lacks of all that the market has; one month was taken from two of them on purpose."""
    b = bars(spark, d)
    cache = b.where("not (ticker in ('Brand#3', 'Brand#8') and date between '1998-03-01' and '1998-03-31')")
    return files.missing_parts(cache.withColumn("m", F.trunc("date", "month")), b.select(F.trunc("date", "month").alias("m")), "ticker", "m").select("ticker", F.col("m").alias("missing"))


@query("prj16", "SELECT s_suppkey, CASE WHEN c1 <> c2 THEN abs(pc - c1) < abs(pc - c2) ELSE op <> lo END AND abs(pc / c1 - 1) <= 0.05 AS usable FROM (SELECT s_suppkey, 100.0 + s_suppkey % 7 AS c1, 100.0 + s_suppkey % 5 AS c2, 100.0 + s_suppkey % 6 AS pc, s_suppkey % 3 AS op, s_suppkey % 2 AS lo FROM supplier)")
def prj16(spark, d):
    """Whether a quote is of today's session: its previous close is nearer yesterday's, or after two flat days its open differs; wild prints are refused."""
    k = F.col("s_suppkey")
    q = table(spark, d, "supplier").select("s_suppkey", (100.0 + k % 7).alias("c1"), (100.0 + k % 5).alias("c2"), (100.0 + k % 6).alias("pc"), (k % 3).alias("op"), (k % 2).alias("lo"))
    today = F.when(F.col("c1") != F.col("c2"), F.abs(F.col("pc") - F.col("c1")) < F.abs(F.col("pc") - F.col("c2"))).otherwise(F.col("op") != F.col("lo"))
    return q.select("s_suppkey", (today & (F.abs(F.col("pc") / F.col("c1") - 1) <= 0.05)).alias("usable"))


@query("snk09", "SELECT s_suppkey, 'S' || s_suppkey || '|1999-01-01' AS custom_id, length(s_name) / 4.0 AS tokens FROM supplier")
def snk09(spark, d):
    """Request lines for a text scorer, read back."""
    s = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.lit("1999-01-01").cast("date").alias("date"), F.col("s_name").alias("body"))
    r = files.score_requests(s)
    return r.select(F.regexp_extract("ticker", r"\d+", 0).cast("long").alias("s_suppkey"), F.get_json_object("line", "$.custom_id").alias("custom_id"), "tokens")


@query("snk10", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE least(greatest(CAST(s_suppkey % 17 - 8 AS DOUBLE), -5), 5) END AS score, CASE WHEN s_suppkey % 4 <> 0 AND s_suppkey % 3 = 0 THEN 'raised' ELSE 'none' END AS guidance FROM supplier")
def snk10(spark, d):
    """Scorer responses: clamped, enumerated, malformed ones empty."""
    k = F.col("s_suppkey")
    body = F.when(k % 4 == 0, F.lit("not json")).otherwise(F.concat(F.lit('{"score": '), (k % 17 - 8).cast("string"), F.lit(', "guidance": "'), F.when(k % 3 == 0, "Raised").otherwise("up"), F.lit('"}')))
    r = files.parse_scores(table(spark, d, "supplier").select(F.concat(F.lit("S"), k.cast("string"), F.lit("|1999-01-01")).alias("custom_id"), body.alias("content")))
    return r.select(F.substring("ticker", 2, 9).cast("long").alias("s_suppkey"), "score", "guidance")


@query("stm08", sql("", "filings").rstrip() + ", top AS (SELECT *, max(period_date) OVER (PARTITION BY ticker ORDER BY filing_date, period_date ROWS UNBOUNDED PRECEDING) AS newest FROM filings) SELECT ticker, count(*) FILTER (WHERE newest <> period_date) AS late FROM top GROUP BY 1")
def stm08(spark, d):
    """Late filings that the newest-period rule sets aside."""
    f = filings(spark, d)
    w = Window.partitionBy("ticker").orderBy("filing_date", "period_date").rowsBetween(Window.unboundedPreceding, 0)
    return f.withColumn("newest", F.max("period_date").over(w)).groupBy("ticker").agg(F.count_if(F.col("newest") != F.col("period_date")).alias("late"))
