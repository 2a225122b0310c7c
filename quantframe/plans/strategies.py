"""Label, split, strategy, execution and model queries (LAB, CPC, ML, STR, EXE, RUN, SIZ, RSK)."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import change, pct_rank, surprise
from ..operators import clean as C
from ..operators import execution as X
from ..operators import joins as J
from ..operators import labels as L
from ..operators import stats as S
from ..operators import strategies as T
from ..operators import windows as W
from ..operators.joins import asof
from ..sources import files
from ..sources.market import bars, brand_of, filings, reports, returns, sql, table
from .registry import query

BY = "OVER (PARTITION BY ticker ORDER BY date)"


def frame(n: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _events(b):
    return b.select("ticker", F.col("date").alias("t0"))


_LAB = f"""numbered AS (SELECT *, row_number() {BY} AS n, CASE WHEN count(x) {frame(21)} = 21 THEN avg(x) {frame(21)} END AS atr FROM (SELECT *, abs(close - lag(close) {BY}) AS x FROM bars)),
    ev AS (SELECT ticker, date AS t0, n, {{0}} AS px, {{0}} + 2 * atr AS top, {{0}} - atr AS floor FROM numbered WHERE atr > 0),
    ahead AS (SELECT e.ticker, e.t0, e.px, f.n AS fn, f.date, f.close, CASE WHEN f.close >= e.top THEN 1 WHEN f.close <= e.floor THEN -1 ELSE 0 END AS hit FROM ev e JOIN numbered f ON f.ticker = e.ticker AND f.n BETWEEN e.n + 1 AND e.n + 20),
    firsts AS (SELECT ticker, t0, any_value(px) AS px, coalesce(min(fn) FILTER (WHERE hit <> 0), max(fn)) AS fn FROM ahead GROUP BY 1, 2)
    SELECT a.ticker, a.t0, a.date AS t1, a.hit AS label, ROUND(a.close / a.px - 1, 6) AS ret FROM firsts JOIN ahead a USING (ticker, t0, fn)"""


@query("lab01", sql("", "bars").rstrip() + ", " + _LAB.format("close"))
def lab01(spark, d):
    b = bars(spark, d)
    return L.triple_barrier(b, _events(b)).withColumn("ret", F.round("ret", 6))


@query("lab02", sql("", "bars").rstrip() + ", " + _LAB.format("CASE WHEN month(date) % 2 = 0 THEN open ELSE close END"))
def lab02(spark, d):
    """Entry price given for some events."""
    b = bars(spark, d)
    ev = b.select("ticker", F.col("date").alias("t0"), F.when(F.month("date") % 2 == 0, F.col("open")).alias("entry"))
    return L.triple_barrier(b, ev).withColumn("ret", F.round("ret", 6))


@query("lab03")
def lab03(spark, d):
    """Probability that a momentum side is right, by a forest over three features.

    Bars and labelled rows are stored, as the fit reads its rows again and again: trades are read once.
    """
    b = W.volatility(W.from_high(W.gap(files.stored(bars(spark, d), "bars"))), 21)
    side = b.select("ticker", F.col("date").alias("t0"), F.signum("ret_10d").alias("side"), "gap_1d", "pct_from_high", "vol_21d").dropna()
    rows = files.stored(L.meta_labels(side, L.triple_barrier(b, _events(b)).where("label <> 0")), "labelled")
    out = L.meta_probability(L.fit_meta(rows, ["gap_1d", "pct_from_high", "vol_21d"]), rows)
    return out.select("ticker", "t0", "y", F.round("proba", 6).alias("proba"))


def _cpcv_sql(n: int, k: int) -> str:
    return f"""days AS (SELECT date, least((row_number() OVER (ORDER BY date) - 1) // ((SELECT count(DISTINCT date) FROM bars) // {n}), {n - 1}) AS g FROM (SELECT DISTINCT date FROM bars)),
    spans AS (SELECT g, min(date) AS a, max(date) AS b FROM days GROUP BY g),
    edges AS (SELECT g, (a + CASE isodow(a) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END) - 28 AS lo, (b - CASE isodow(b) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END) + 7 AS hi FROM spans),
    splits AS (SELECT row_number() OVER (ORDER BY x.g, y.g) - 1 AS split, x.g AS g1, y.g AS g2 FROM spans x JOIN spans y ON x.g < y.g),
    roles AS (SELECT CAST(split AS INTEGER) AS split, date, CASE WHEN d.g IN (g1, g2) THEN 'test' WHEN date BETWEEN p.lo AND p.hi OR date BETWEEN q.lo AND q.hi THEN NULL ELSE 'train' END AS role
        FROM splits CROSS JOIN days d JOIN edges p ON p.g = g1 JOIN edges q ON q.g = g2)"""


@query("cpc01", sql("", "bars").rstrip() + f", {_cpcv_sql(6, 2)} SELECT split, date, role FROM roles WHERE role IS NOT NULL")
def cpc01(spark, d):
    return L.cpcv(bars(spark, d))


@query(
    "cpc02",
    sql("", "bars").rstrip()
    + f""", {_cpcv_sql(4, 2)} SELECT split, CAST(seg AS BIGINT) AS seg, min(date) AS "start", max(date) AS "end", count(*) AS n FROM (
    SELECT split, date, sum(CASE WHEN gap > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY split ORDER BY date) AS seg FROM (SELECT split, date, date - lag(date) OVER (PARTITION BY split ORDER BY date) AS gap FROM roles WHERE role = 'test')) GROUP BY 1, 2""",
)
def cpc02(spark, d):
    return L.runner_folds(L.cpcv(bars(spark, d), groups=4))


def _training(spark, d):
    b = W.forward_return(W.gap(bars(spark, d)), 5)
    every = F.broadcast(W.calendar(b).where("idx % 5 = 0").select("date"))
    t = b.join(every, "date").where("close >= 5 and fwd is not null")
    t = t.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("date"))).where("n >= 10")
    rank = lambda c: F.coalesce(pct_rank(c, ["date"]), F.lit(0.5)).alias(c)
    return t.select("date", "ticker", rank("gap_1d"), rank("ret_10d"), rank("volume"), "fwd")


_RANK = "coalesce(CASE WHEN {0} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {0} NULLS LAST) + (count(*) OVER (PARTITION BY date, {0}) - 1) / 2.0) / CAST(count({0}) OVER (PARTITION BY date) AS DOUBLE) END, 0.5)"


@query(
    "ml01",
    sql(
        f"""SELECT date, ticker, ROUND({_RANK.format('gap_1d')}, 6) AS gap_1d, ROUND({_RANK.format('ret_10d')}, 6) AS ret_10d, ROUND({_RANK.format('volume')}, 6) AS volume, ROUND(fwd, 6) AS fwd FROM (
        SELECT *, count(*) OVER (PARTITION BY date) AS n FROM (
        SELECT b.*, CASE WHEN o1.open > 0 AND oh.open > 0 THEN oh.open / o1.open - 1 END AS fwd
        FROM (SELECT *, open / lag(close) {BY} - 1 AS gap_1d, close / lag(close, 10) {BY} - 1 AS ret_10d FROM bars) b JOIN calendar c USING (date)
        LEFT JOIN (SELECT ticker, idx, open FROM bars JOIN calendar USING (date)) o1 ON o1.ticker = b.ticker AND o1.idx = c.idx + 1
        LEFT JOIN (SELECT ticker, idx, open FROM bars JOIN calendar USING (date)) oh ON oh.ticker = b.ticker AND oh.idx = c.idx + 6
        WHERE c.idx % 5 = 0 AND b.close >= 5) WHERE fwd IS NOT NULL) WHERE n >= 10""",
        "bars", "calendar",
    ),
)
def ml01(spark, d):
    t = _training(spark, d)
    return t.select("date", "ticker", *[F.round(c, 6).alias(c) for c in ("gap_1d", "ret_10d", "volume", "fwd")])


def _ranked(spark, d):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    names = ["gap_1d", "ret_10d", "volume"]
    t = _training(spark, d).where("date < '2000-05-21'")
    if t.isEmpty():  # too few names a day to rank: nothing is scored
        return bars(spark, d).select("date", "ticker", F.lit(None).cast("double").alias("score"))
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="x"), GBTRegressor(featuresCol="x", labelCol="fwd", maxIter=10, maxDepth=3, minInstancesPerNode=100, stepSize=0.1, seed=7)]).fit(t)
    b = W.gap(bars(spark, d))
    rank = lambda c: F.coalesce(pct_rank(c, ["date"]), F.lit(0.5)).alias(c)
    return model.transform(b.select("date", "ticker", *[rank(c) for c in names])).select("date", "ticker", F.col("prediction").alias("score"))


@query("ml02")
def ml02(spark, d):
    """Top decile by model score on the first market day of each month."""
    s = _ranked(spark, d)
    first = s.groupBy(F.trunc("date", "month").alias("m")).agg(F.min("date").alias("date")).select("date")
    return C.top_share(s.join(F.broadcast(first), "date"), "score", ["date"], ["ticker"]).select("date", "ticker", F.round("score", 8).alias("score"))


@query("str08")
def str08(spark, d):
    """The ranker as a strategy: its monthly picks, equal weight, held between."""
    p = ml02(spark, d).withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy("date")))
    b = bars(spark, d)
    return T.carry(p.select("date", "ticker", "weight"), b.select("date").distinct(), b)


_CARRY = "SELECT d.date, t.ticker, ROUND(t.weight, 6) AS weight FROM (SELECT d.date, max(x.date) AS decided FROM (SELECT DISTINCT date FROM bars) d JOIN (SELECT DISTINCT date FROM picks) x ON x.date <= d.date GROUP BY 1) d JOIN picks t ON t.date = d.decided JOIN bars b ON b.date = d.date AND b.ticker = t.ticker"


_MOMENTUM_PICKS = f"""scored AS (SELECT *, lag(close, 20) {BY} / lag(close, 272) {BY} - 1 AS mom FROM bars),
    firsts AS (SELECT min(date) AS date FROM bars GROUP BY date_trunc('month', date)),
    cut AS (SELECT *, quantile_cont(mom, 0.8::DOUBLE) OVER (PARTITION BY date) AS q, count(*) OVER (PARTITION BY date) AS n FROM scored JOIN firsts USING (date) WHERE mom IS NOT NULL),
    picks AS (SELECT date, ticker, 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM cut WHERE n >= 5 AND mom >= q)"""


@query(
    "str01",
    sql("", "bars").rstrip()
    + f", {_MOMENTUM_PICKS} {_CARRY}",
)
def str01(spark, d):
    return T.momentum(bars(spark, d)).withColumn("weight", F.round("weight", 6))


_ZS = "coalesce(({0} - avg({0}) OVER (PARTITION BY period_date)) / nullif(stddev_pop({0}) OVER (PARTITION BY period_date), 0), 0)"


_QUALITY_PICKS = f"""facts AS (SELECT DISTINCT ticker, period_date, roe, margin, leverage / (abs(leverage) + 1e5) AS lev FROM filings),
    scored AS (SELECT *, ROUND({_ZS.format('roe')} - {_ZS.format('lev')} + {_ZS.format('margin')}, 9) AS s FROM facts),
    cut AS (SELECT *, quantile_cont(s, 0.8::DOUBLE) OVER (PARTITION BY period_date) AS q, count(*) OVER (PARTITION BY period_date) AS n FROM scored),
    picks AS (SELECT CAST(period_date + 45 AS DATE) AS date, ticker, 1.0 / count(*) OVER (PARTITION BY period_date) AS weight FROM cut WHERE n >= 5 AND s >= q)"""


@query(
    "str02",
    sql("", "bars", "filings").rstrip()
    + f", {_QUALITY_PICKS} {_CARRY}",
)
def str02(spark, d):
    f = filings(spark, d).select("ticker", "period_date", "roe", "margin", (F.col("leverage") / (F.abs("leverage") + 1e5)).alias("lev")).distinct()
    return T.quality(f, bars(spark, d)).withColumn("weight", F.round("weight", 6))


_PEAD = f"""reactions AS (SELECT DISTINCT r.ticker, (SELECT min(b.date) FROM bars b WHERE b.ticker = r.ticker AND b.date >= r.date + CASE WHEN r.time = 'bmo' THEN 0 ELSE 1 END) AS date FROM reports r
    WHERE actual > estimate AND r.date >= (SELECT min(b.date) FROM bars b WHERE b.ticker = r.ticker))"""


def _held_sql(hold: int) -> str:
    """Greedy holds over numbered (ticker, date, n, entry): an entry while none is held takes its bar, the next hold - 1 and one of 0."""
    return f"""e AS (SELECT ticker, n FROM numbered WHERE entry),
    nx AS (SELECT a.ticker, a.n, min(b.n) AS later FROM e a JOIN e b ON b.ticker = a.ticker AND b.n > a.n + {hold} GROUP BY 1, 2),
    taken AS (SELECT ticker, min(n) AS n FROM e GROUP BY 1 UNION ALL SELECT t.ticker, nx.later FROM taken t JOIN nx ON nx.ticker = t.ticker AND nx.n = t.n)
    SELECT b.date, b.ticker, CASE WHEN b.n < t.n + {hold} THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM taken t JOIN numbered b ON b.ticker = t.ticker AND b.n BETWEEN t.n AND t.n + {hold}"""


def _recursive(body: str) -> str:
    return "WITH RECURSIVE " + body.removeprefix("WITH ")


@query(
    "str03",
    _recursive(sql("", "bars", "reports").rstrip())
    + f""", {_PEAD}, numbered AS (SELECT b.ticker, b.date, row_number() OVER (PARTITION BY b.ticker ORDER BY b.date) AS n, r.date IS NOT NULL AND coalesce(b.close / b.before >= 1.01, false) AS entry
    FROM (SELECT *, lag(close) {BY} AS before FROM bars) b LEFT JOIN reactions r ON r.ticker = b.ticker AND r.date = b.date), {_held_sql(10)}""",
)
def str03(spark, d):
    """Beats on a rising close, 2 % for 10 bars, then 0 once."""
    b = bars(spark, d)
    beat = J.reaction_bars(reports(spark, d).where("actual > estimate"), b).select("ticker", F.col("reaction").alias("date")).distinct().withColumn("beat", F.lit(True))
    rows = b.join(beat, ["ticker", "date"], "left").withColumn("entry", F.coalesce("beat", F.lit(False)) & F.coalesce(F.col("close") / W.lag("close") >= 1.01, F.lit(False)))
    return T.hold_entries(rows, 10)


@query("prj10", sql("", "bars", "reports").rstrip() + f", {_PEAD} SELECT ticker, date FROM (SELECT *, open / lag(close) {BY} - 1 AS gap FROM bars) JOIN reactions USING (ticker, date) WHERE gap >= 0.03")
def prj10(spark, d):
    """Entry predicate on reaction bars: a beat and a gap up."""
    b = W.gap(bars(spark, d))
    beat = J.reaction_bars(reports(spark, d).where("actual > estimate"), b).select("ticker", F.col("reaction").alias("date")).distinct()
    return b.join(beat, ["ticker", "date"], "left_semi").where("gap_1d >= 0.03").select("ticker", "date")


_REPORTED = """reported AS (SELECT ticker, date, (actual - estimate) / nullif(abs(estimate), 0) AS surprise, (revenue - expected) / nullif(abs(expected), 0) AS revenue_surprise FROM (
    SELECT 'Brand#' || (o_custkey % 25 + 1) AS ticker, CAST(o_orderdate AS DATE) AS date, o_totalprice AS actual, o_totalprice * (1 + (o_orderkey % 21 - 10) / 100) AS estimate, o_totalprice AS revenue, o_totalprice * (1 + (o_custkey % 17 - 8) / 100) AS expected,
           row_number() OVER (PARTITION BY 'Brand#' || (o_custkey % 25 + 1), CAST(o_orderdate AS DATE) ORDER BY o_orderkey, o_totalprice) AS k FROM orders) WHERE k = 1)"""


def _panel(spark, d):
    """Bars with what the entry rule reads: earnings and revenue surprise of the last report, bars since its reaction, gap, run-up and the market's return."""
    b = W.gap(W.lookback_returns(bars(spark, d), (1,)))
    o = table(spark, d, "orders")
    raw = o.select(brand_of(F.col("o_custkey")).alias("ticker"), F.to_date("o_orderdate").alias("date"), "o_orderkey", F.col("o_totalprice").alias("actual"), (F.col("o_totalprice") * (1 + (F.col("o_orderkey") % 21 - 10) / 100)).alias("estimate"), (F.col("o_totalprice") * (1 + (F.col("o_custkey") % 17 - 8) / 100)).alias("expected"))
    first = C.keep_one(raw, ["ticker", "date"], [F.col("o_orderkey"), F.col("actual")])
    reported = first.select("ticker", F.col("date").alias("__rd"), surprise("actual", "estimate").alias("surprise"), surprise("actual", "expected").alias("revenue_surprise"))
    p = J.days_since_reaction(asof(b, reported, ["ticker"], "date", "__rd", ["surprise", "revenue_surprise"]), reports(spark, d))
    m = b.groupBy("date").agg(F.avg("ret_1d").alias("sector_ret_1d"))
    return T.surprise_entries(p.join(m, "date"))


@query(
    "str04",
    _recursive(sql("", "bars", "reports").rstrip())
    + f""", {_REPORTED}, hits AS (SELECT DISTINCT r.ticker, (SELECT min(b.date) FROM bars b WHERE b.ticker = r.ticker AND b.date >= r.date + CASE WHEN r.time = 'bmo' THEN 0 ELSE 1 END) AS date FROM reports r WHERE r.date >= (SELECT min(b.date) FROM bars b WHERE b.ticker = r.ticker)),
    f AS (SELECT *, close / lag(close) {BY} - 1 AS ret_1d, open / lag(close) {BY} - 1 AS gap_1d, close / lag(close, 10) {BY} - 1 AS ret_10d, row_number() {BY} AS n FROM bars),
    m AS (SELECT date, avg(ret_1d) AS market FROM f GROUP BY date),
    known AS (SELECT f.*, r.surprise, r.revenue_surprise FROM f ASOF LEFT JOIN reported r ON f.ticker = r.ticker AND f.date >= r.date),
    numbered AS (SELECT k.ticker, k.date, k.n, coalesce(h.date IS NOT NULL AND surprise >= 0.05 AND revenue_surprise > 0 AND gap_1d >= 0.03 AND (1 + ret_10d) / nullif(1 + ret_1d, 0) - 1 <= 0.10 AND market > -0.015, false) AS entry
                 FROM known k JOIN m USING (date) LEFT JOIN hits h ON h.ticker = k.ticker AND h.date = k.date), {_held_sql(10)}""",
)
def str04(spark, d):
    """Surprise entries held for ten bars; every name on its own, without a limit of names or a stop (see README)."""
    return T.hold_entries(_panel(spark, d).select("ticker", "date", "entry"), 10)


_WORDS = "[rtrim(ltrim(w, '.,;:!?\"''()'), '.,;:!?\"''()') for w in string_split_regex(lower(text), '\\s+') if w <> '']"


def _count_sql(words: list[str]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"len([x for x in ws if x IN ({listed})])"


@query("str05", f"SELECT doc_id, ROUND(CASE WHEN len(ws) > 0 THEN ({_count_sql(T.POSITIVE + ['the'])} - {_count_sql(T.NEGATIVE + ['der'])}) / len(ws) - 0.5 * {_count_sql(T.UNCERTAIN)} / len(ws) ELSE 0 END, 9) AS score FROM (SELECT doc_id, {_WORDS} AS ws FROM documents)")
def str05(spark, d):
    """Transcript score; two common words of the invented prose stand in the lexicons so that scores differ."""
    return table(spark, d, "documents").select("doc_id", F.round(T.transcript_score(F.col("text"), T.POSITIVE + ["the"], T.NEGATIVE + ["der"]), 9).alias("score"))


@query(
    "str06",
    _recursive(sql("", "bars", "filings").rstrip())
    + f""", changes AS (SELECT *, lag(roe) OVER (PARTITION BY ticker, quarter(period_date) ORDER BY period_date) AS p FROM (SELECT DISTINCT ticker, period_date, roe FROM filings)),
    reactions AS (SELECT DISTINCT c.ticker, (SELECT min(b.date) FROM bars b WHERE b.ticker = c.ticker AND b.date >= c.period_date) AS date FROM changes c
        WHERE (roe - p) / abs(p) >= 0.05 AND c.period_date >= (SELECT min(b.date) FROM bars b WHERE b.ticker = c.ticker)),
    numbered AS (SELECT b.ticker, b.date, row_number() OVER (PARTITION BY b.ticker ORDER BY b.date) AS n, r.date IS NOT NULL AS entry
        FROM bars b LEFT JOIN reactions r ON r.ticker = b.ticker AND r.date = b.date), {_held_sql(21)}""",
)
def str06(spark, d):
    """Yearly change of a reported figure of at least 5 %, 2 % for 21 bars from the next bar."""
    f = filings(spark, d).select("ticker", "period_date", "roe").distinct()
    p = F.lag("roe").over(Window.partitionBy("ticker", F.quarter("period_date")).orderBy("period_date"))
    up = f.withColumn("p", p).where((F.col("roe") - F.col("p")) / F.abs("p") >= 0.05).select("ticker", F.col("period_date").alias("date"), F.lit("bmo").alias("time"))
    b = bars(spark, d)
    hit = J.reaction_bars(up, b).select("ticker", F.col("reaction").alias("date")).distinct().withColumn("entry", F.lit(True))
    return T.hold_entries(b.join(hit, ["ticker", "date"], "left").withColumn("entry", F.coalesce("entry", F.lit(False))), 21)


@query("str07", sql(f"SELECT date, ticker, ROUND(CASE WHEN trend > 0 THEN (1 / vol) / sum(1 / vol) OVER (PARTITION BY date) ELSE 0 END, 6) AS weight FROM (SELECT ticker, date, close / lag(close, 252) {BY} - 1 AS trend, CASE WHEN count(r) {frame(63)} = 63 THEN stddev_samp(r) {frame(63)} * sqrt(252) END AS vol FROM (SELECT *, close / lag(close) {BY} - 1 AS r FROM bars)) WHERE trend IS NOT NULL AND vol > 0", "bars"))
def str07(spark, d):
    f = W.volatility(bars(spark, d), 63, "vol").withColumn("trend", change(F.col("close"), W.lag("close", 252)))
    return T.etf_trend(f.select("date", "ticker", "trend", "vol")).withColumn("weight", F.round("weight", 6))


# --- execution ---

_TARGETS = "targets AS (SELECT 'a' AS run, date, ticker, volume / 100 - 0.2 AS weight FROM bars)"


def _targets(spark, d):
    return bars(spark, d).select(F.lit("a").alias("run"), "date", "ticker", (F.col("volume") / 100 - 0.2).alias("weight"))


_NORM = "SELECT run, date, ticker, weight / greatest(1, sum(weight) OVER (PARTITION BY run, date)) AS weight FROM targets WHERE weight > 0"


@query("exe01", sql("", "bars").rstrip() + f", {_TARGETS} SELECT date, ticker, ROUND(weight, 10) AS weight FROM ({_NORM})")
def exe01(spark, d):
    return X.normalise(_targets(spark, d)).select("date", "ticker", F.round("weight", 10).alias("weight"))


@query("exe02", sql("", "bars").rstrip() + f", {_TARGETS} SELECT date, ticker, ROUND(least(weight, 0.1), 10) AS weight FROM ({_NORM})")
def exe02(spark, d):
    return X.cap(X.normalise(_targets(spark, d))).select("date", "ticker", F.round("weight", 10).alias("weight"))


_EXACT_CARRY = _CARRY.replace("ROUND(t.weight, 6) AS weight", "t.weight")


def _strategy_sql(name: str) -> str:
    """CTEs of a strategy's targets, `<name>_t` (date, ticker, weight), from the SQL of its own query, without rounding."""
    if name == "trend":
        return f"trend_t AS (SELECT date, ticker, CASE WHEN trend > 0 THEN (1 / vol) / sum(1 / vol) OVER (PARTITION BY date) ELSE 0 END AS weight FROM (SELECT ticker, date, close / lag(close, 252) {BY} - 1 AS trend, CASE WHEN count(r) {frame(63)} = 63 THEN stddev_samp(r) {frame(63)} * sqrt(252) END AS vol FROM (SELECT *, close / lag(close) {BY} - 1 AS r FROM bars)) WHERE trend IS NOT NULL AND vol > 0)"
    inner = {"momentum": _MOMENTUM_PICKS, "quality": _QUALITY_PICKS}[name] + f", t AS ({_EXACT_CARRY})"
    for cte in ("facts", "scored", "firsts", "cut", "picks", "t"):
        inner = re.sub(rf"\b{cte}\b(?=( AS \(| JOIN|\)| WHERE| x\b| t\b| USING))", f"{name}_{cte}", inner) if cte != "t" else inner.replace(", t AS (", f", {name}_t AS (")
    return inner


_BACKTEST = """tn AS (SELECT run, date, ticker, least(weight / greatest(1, sum(weight) OVER (PARTITION BY run, date)), 0.1) AS weight FROM goals WHERE weight > 0),
    px AS (SELECT run, ticker, date, open / lag(open) OVER (PARTITION BY run, ticker ORDER BY date) - 1 AS gain FROM opens WHERE open > 0),
    market AS (SELECT run, date, lead(date) OVER (PARTITION BY run ORDER BY date) AS nx FROM (SELECT DISTINCT run, date FROM px)),
    held AS (SELECT d.run, d.nx AS date, t.ticker, t.weight FROM tn t JOIN market d USING (run, date) JOIN px ON px.run = d.run AND px.date = d.nx AND px.ticker = t.ticker),
    olds AS (SELECT d.run, d.nx AS date, h.ticker, h.weight AS old, coalesce(px.gain, 0) AS gain FROM held h JOIN market d USING (run, date) LEFT JOIN px ON px.run = d.run AND px.date = d.nx AND px.ticker = h.ticker WHERE d.nx IS NOT NULL),
    gains AS (SELECT run, date, sum(old * gain) AS g FROM olds GROUP BY run, date),
    moves AS (SELECT run, date, sum(abs(coalesce(h.weight, 0) - coalesce(o.old, 0) * (1 + coalesce(o.gain, 0)) / (1 + coalesce(g, 0)))) AS moved FROM held h FULL JOIN olds o USING (run, date, ticker) LEFT JOIN gains USING (run, date) GROUP BY run, date),
    acts AS (SELECT run, date FROM held UNION SELECT run, date FROM olds UNION SELECT run, date FROM tn SEMI JOIN market USING (run, date)),
    navs AS (SELECT run, date, ln(100000.0) + sum(ln((1 + coalesce(g, 0)) * (1 - coalesce(moved, 0) * 11 / 1e4))) OVER (PARTITION BY run ORDER BY date) AS log_nav FROM acts LEFT JOIN gains USING (run, date) LEFT JOIN moves USING (run, date)),
    rets AS (SELECT * FROM (SELECT run AS series_id, date, exp(log_nav - lag(log_nav) OVER (PARTITION BY run ORDER BY date)) - 1 AS ret FROM navs) WHERE ret IS NOT NULL)"""


def runs_sql(*names: str) -> str:
    """CTEs up to navs and rets of a backtest in which each strategy is a run over all bars."""
    goals = " UNION ALL ".join(f"SELECT '{n}' AS run, date, ticker, weight FROM {n}_t" for n in names)
    return ", " + ", ".join(_strategy_sql(n) for n in names) + f", goals AS ({goals}), opens AS (SELECT r.run, b.date, b.ticker, b.open FROM bars b CROSS JOIN (SELECT DISTINCT run FROM goals) r), {_BACKTEST} "


_FOLDS_SQL = f""", {_cpcv_sql(4, 2)}, folds AS (SELECT CAST(split AS VARCHAR) || '-' || CAST(CAST(seg AS BIGINT) AS VARCHAR) AS run, min(date) AS a, max(date) AS b FROM (
    SELECT split, date, sum(CASE WHEN gap > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY split ORDER BY date) AS seg FROM (SELECT split, date, date - lag(date) OVER (PARTITION BY split ORDER BY date) AS gap FROM roles WHERE role = 'test')) GROUP BY split, seg),
    {_strategy_sql('momentum')}, goals AS (SELECT run, date, ticker, weight FROM momentum_t JOIN folds ON date BETWEEN a AND b), opens AS (SELECT run, date, ticker, open FROM bars JOIN folds ON date BETWEEN a AND b), {_BACKTEST} """
_DRAWN = "SELECT series_id, ROUND(max(1 - nav / greatest(top, 1.0)), 6) AS max_drawdown FROM (SELECT *, max(nav) OVER (PARTITION BY series_id ORDER BY date) AS top FROM (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY series_id ORDER BY date)) AS nav FROM {0})) GROUP BY series_id"


def _momentum_nav(spark, d, **account):
    b = files.stored(bars(spark, d), "bars")  # read several times below
    t = T.momentum(b).withColumn("run", F.lit("momentum"))
    return X.backtest(X.normalise(t), b, **account)


@query("exe03", sql("", "bars").rstrip() + runs_sql("momentum") + "SELECT run, date, ROUND(log_nav, 6) AS log_nav FROM navs")
def exe03(spark, d):
    """Momentum targets filled on the next bar's open, with costs and cap."""
    return _momentum_nav(spark, d).select("run", "date", F.round("log_nav", 6).alias("log_nav"))


@query(
    "exe04",
    sql("", "bars").rstrip()
    + """, px AS (SELECT ticker, date, open / lag(open) OVER (PARTITION BY ticker ORDER BY date) - 1 AS gain FROM bars WHERE open > 0),
    days AS (SELECT date, lead(date) OVER (ORDER BY date) AS nx FROM (SELECT DISTINCT date FROM px)),
    held AS (SELECT d.nx AS date, t.ticker, t.weight FROM (SELECT date, ticker, 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM bars) t JOIN days d USING (date) JOIN px ON px.date = d.nx AND px.ticker = t.ticker),
    g AS (SELECT d.nx AS date, sum(h.weight * coalesce(px.gain, 0)) AS g FROM held h JOIN days d USING (date) LEFT JOIN px ON px.date = d.nx AND px.ticker = h.ticker GROUP BY 1)
    SELECT date, ROUND(sum(ln(1 + coalesce(g, 0))) OVER (ORDER BY date) + ln(100000.0), 6) AS log_nav FROM days LEFT JOIN g USING (date)""",
)
def exe04(spark, d):
    """Without costs or cap, all names of a day in equal parts, rebalanced daily."""
    b = bars(spark, d)
    t = b.select(F.lit("x").alias("run"), "date", "ticker", (1 / F.count(F.lit(1)).over(Window.partitionBy("date"))).alias("weight"))
    return X.backtest(t, b, cost_bps=0.0, most=None).select("date", F.round("log_nav", 6).alias("log_nav"))


@query("exe05", sql("", "bars").rstrip() + runs_sql("momentum") + "SELECT series_id, date, ROUND(ret, 7) + 0.0 AS ret FROM rets")
def exe05(spark, d):
    return X.nav_returns(_momentum_nav(spark, d)).withColumn("ret", F.round("ret", 7) + 0.0)


_POS = "t AS (SELECT s_suppkey AS k, s_acctbal / 100000 AS w FROM supplier WHERE s_suppkey % 3 > 0), p AS (SELECT s_suppkey AS k, CAST(s_suppkey % 40 AS DOUBLE) AS shares FROM supplier WHERE s_suppkey % 5 > 0), px AS (SELECT s_suppkey AS k, 10.0 + s_suppkey % 90 AS price FROM supplier)"


def _orders(spark, d):
    s = table(spark, d, "supplier")
    sym = F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol")
    t = s.where("s_suppkey % 3 > 0").select(sym, (F.col("s_acctbal") / 100000).alias("weight"))
    p = s.where("s_suppkey % 5 > 0").select(sym, (F.col("s_suppkey") % 40).cast("double").alias("shares"))
    px = s.select(sym, (F.lit(10.0) + F.col("s_suppkey") % 90).alias("price"))
    return X.reconcile(t, p, px, 50_000.0), px


@query(
    "exe06",
    f"""WITH {_POS}, j AS (SELECT k, coalesce(w, 0) AS w, coalesce(shares, 0) AS have, price FROM t FULL JOIN p USING (k) LEFT JOIN px USING (k)),
    o AS (SELECT k, CASE WHEN w <= 0 THEN 0 ELSE floor(w * 50000 / price) END - have AS delta, w <= 0 AND have > 0 AS out, have, price FROM j)
    SELECT 'S' || k AS symbol, CASE WHEN out THEN have ELSE abs(delta) END AS qty, CASE WHEN delta > 0 THEN 'buy' ELSE 'sell' END AS side FROM o WHERE out OR (abs(delta) >= 1 AND abs(delta) * price >= 1)""",
)
def exe06(spark, d):
    return _orders(spark, d)[0]


@query(
    "exe07",
    """WITH o AS (SELECT 'S' || s_suppkey AS symbol, (s_suppkey % 7) + (s_suppkey % 4) / 4.0 AS qty, CASE WHEN s_suppkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, 1.0 + s_suppkey % 5 AS price, s_suppkey % 3 > 0 AS ok FROM supplier)
    SELECT symbol, CAST(floor(qty) AS DOUBLE) AS qty, 'opg' AS tif, side FROM o WHERE floor(qty) > 0
    UNION ALL SELECT symbol, CAST(qty - floor(qty) AS DOUBLE), 'day', side FROM o WHERE qty > floor(qty) AND ok AND (side = 'sell' OR (qty - floor(qty)) * price >= 1)""",
)
def exe07(spark, d):
    s = table(spark, d, "supplier")
    o = s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), (F.col("s_suppkey") % 7 + (F.col("s_suppkey") % 4) / 4.0).alias("qty"), F.when(F.col("s_suppkey") % 2 == 0, "buy").otherwise("sell").alias("side"), (F.lit(1.0) + F.col("s_suppkey") % 5).alias("price"), (F.col("s_suppkey") % 3 > 0).alias("fractionable"))
    return X.split_legs(o)


def _fold_navs(spark, d):
    b = files.stored(bars(spark, d), "bars")
    folds = L.runner_folds(L.cpcv(b, groups=4)).select(F.concat_ws("-", "split", "seg").alias("run"), "start", "end")
    inside = lambda df: df.join(F.broadcast(folds), (F.col("date") >= F.col("start")) & (F.col("date") <= F.col("end")))
    t = X.normalise(inside(T.momentum(b)).select("run", "date", "ticker", "weight"))
    return X.backtest(t, inside(b).select("run", "date", "ticker", "open"))


@query("run01", sql("", "bars").rstrip() + _FOLDS_SQL + "SELECT run, date, ROUND(log_nav, 6) AS log_nav FROM navs")
def run01(spark, d):
    """Backtest over purged folds: each (split, segment) is a run of its own, filled on the next bar."""
    return _fold_navs(spark, d).select("run", "date", F.round("log_nav", 6).alias("log_nav"))


@query(
    "run03",
    sql("", "bars").rstrip() + _FOLDS_SQL
    + f""", r AS (SELECT 'momentum' AS series_id, date, avg(ret) AS ret FROM rets GROUP BY date)
    SELECT series_id, ROUND(coalesce(avg(ret) / nullif(stddev_pop(ret), 0), 0) * sqrt(252), 6) AS sharpe, count(*) FILTER (WHERE abs(ret) > 1e-12) AS active_days, count(*) AS n, any_value(max_drawdown) AS max_drawdown
    FROM r JOIN ({_DRAWN.format('r')}) USING (series_id) GROUP BY series_id""",
)
def run03(spark, d):
    """Backtest to metrics: fold returns, averaged by date, then Sharpe, drawdown and activity."""
    r = X.nav_returns(_fold_navs(spark, d)).groupBy("date").agg(F.avg("ret").alias("ret")).withColumn("series_id", F.lit("momentum"))
    m = r.groupBy("series_id").agg(F.round(S.sharpe(population=True), 6).alias("sharpe"), F.count_if(F.abs("ret") > 1e-12).alias("active_days"), F.count(F.lit(1)).alias("n"))
    return m.join(S.drawdown(r).withColumn("max_drawdown", F.round("max_drawdown", 6)), "series_id")


def _books(spark, d):
    """Three strategies as runs of one backtest."""
    b = files.stored(bars(spark, d), "bars")
    f = W.volatility(b, 63, "vol").withColumn("trend", change(F.col("close"), W.lag("close", 252)))
    facts = filings(spark, d).select("ticker", "period_date", "roe", "margin", (F.col("leverage") / (F.abs("leverage") + 1e5)).alias("lev")).distinct()
    named = {"momentum": T.momentum(b), "trend": T.etf_trend(f.select("date", "ticker", "trend", "vol")), "quality": T.quality(facts, b)}
    t = None
    for k, x in named.items():
        one = x.select(F.lit(k).alias("run"), "date", "ticker", "weight")
        t = one if t is None else t.unionByName(one)
    return X.nav_returns(X.backtest(X.normalise(t), b))


@query(
    "run05",
    sql("", "bars", "filings").rstrip() + runs_sql("momentum", "trend", "quality")
    + """, r AS (SELECT * FROM rets WHERE date >= DATE '2000-05-21'), m AS (SELECT * FROM r UNION ALL SELECT 'equal', date, avg(ret) FROM r GROUP BY date)
    SELECT series_id, count(*) AS n, ROUND(coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0) * sqrt(252), 6) AS sharpe FROM m GROUP BY series_id""",
)
def run05(spark, d):
    """Forward book: each signal backtested, then the equal-weight combination."""
    r = _books(spark, d).where("date >= date '2000-05-21'")
    mix = r.groupBy("date").agg(F.avg("ret").alias("ret")).select(F.lit("equal").alias("series_id"), "date", "ret")
    return r.unionByName(mix).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.round(S.sharpe(), 6).alias("sharpe"))


@query(
    "run06",
    sql("", "returns", "book", "filings").rstrip() + runs_sql("momentum", "trend", "quality")
    + f""", r AS (SELECT * FROM rets WHERE date BETWEEN DATE '2000-05-21' AND DATE '2001-05-21'), j AS (SELECT r.series_id, r.ret, k.b FROM r JOIN book k USING (date)),
    o AS (SELECT *, my - beta * mx AS alpha, (syy - beta * sxy) / (n - 2) AS s2 FROM (SELECT series_id, count(*) AS n, avg(b) AS mx, avg(ret) AS my, regr_sxx(ret, b) AS sxx, regr_syy(ret, b) AS syy, regr_sxy(ret, b) AS sxy, regr_sxy(ret, b) / regr_sxx(ret, b) AS beta FROM j GROUP BY 1))
    SELECT series_id, n, ROUND(alpha * 252, 6) AS alpha, ROUND(alpha / sqrt(s2 * (1.0 / n + mx * mx / sxx)), 4) AS alpha_t, max_drawdown FROM o JOIN ({_DRAWN.format('r')}) USING (series_id)""",
)
def run06(spark, d):
    """Holdout evaluation of each signal with benchmark alpha."""
    r = _books(spark, d).where("date between date '2000-05-21' and date '2001-05-21'")
    book = returns(spark, d).groupBy("date").agg(F.avg("ret").alias("b"))
    a = S.benchmark_alpha(r, book).select("series_id", "n", F.round("alpha", 6).alias("alpha"), F.round("alpha_t", 4).alias("alpha_t"))
    return a.join(S.drawdown(r).withColumn("max_drawdown", F.round("max_drawdown", 6)), "series_id")


@query("siz01", "SELECT s_suppkey, CASE WHEN s_acctbal > 0 AND (s_suppkey % 10) / 10.0 >= 0.5 THEN ROUND(least(s_acctbal / 10000 * 0.25 * 1.5 * (s_suppkey % 10) / 10.0, 0.05), 9) ELSE 0 END AS size FROM supplier")
def siz01(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 10000).alias("raw"), ((F.col("s_suppkey") % 10) / 10.0).alias("conf"))
    return s.select("s_suppkey", F.round(X.size("raw", "conf", kelly=1.5), 9).alias("size"))


_BOOK = "(SELECT date, ticker, least(sum(size), 0.05) AS s FROM (SELECT date, ticker, volume / 1000 AS size FROM bars UNION ALL SELECT date, ticker, volume / 2000 FROM bars WHERE day(date) % 2 = 0) GROUP BY 1, 2)"


@query("siz02", sql(f"SELECT date, ticker, ROUND(s * least(1, 0.5 / greatest(sum(s) OVER (PARTITION BY date), 1e-12)), 11) AS weight FROM {_BOOK}", "bars"))
def siz02(spark, d):
    b = bars(spark, d)
    s = b.select("date", F.lit("a").alias("signal"), "ticker", (F.col("volume") / 1000).alias("size"))
    s = s.unionByName(b.where("day(date) % 2 = 0").select("date", F.lit("b").alias("signal"), "ticker", (F.col("volume") / 2000).alias("size")))
    return X.combine_book(s, gross=0.5).withColumn("weight", F.round("weight", 11))


query("agg19", sql(f"SELECT date, ticker, ROUND(s * least(1, 0.5 / greatest(sum(s) OVER (PARTITION BY date), 1e-12)), 11) AS weight FROM {_BOOK}", "bars"))(siz02)

_EQ = "eq AS (SELECT o_custkey AS account, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS equity, bool_or(o_orderkey % 11 = 0) AS resume FROM orders GROUP BY 1, 2)"


@query(
    "rsk01",
    f"""WITH {_EQ}, era AS (SELECT *, sum(CASE WHEN resume THEN 1 ELSE 0 END) OVER w AS era, equity / lag(equity) OVER w - 1 AS day FROM eq WINDOW w AS (PARTITION BY account ORDER BY date)),
    b AS (SELECT *, NOT resume AND (1 - equity / max(equity) OVER (PARTITION BY account, era ORDER BY date) >= 0.15 OR coalesce(day, 0) <= -0.04) AS breach FROM era)
    SELECT account, date, equity, breach, bool_or(breach) OVER (PARTITION BY account, era ORDER BY date) AS halted FROM b""",
)
def rsk01(spark, d):
    o = table(spark, d, "orders")
    eq = o.groupBy(F.col("o_custkey").alias("account"), F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("equity"), F.bool_or(F.col("o_orderkey") % 11 == 0).alias("resume"))
    return X.risk_latch(eq)


@query("win15")
def win15(spark, d):
    """Least order of differencing that makes a ticker's log close stationary (0.1 steps, then 0.01)."""
    return W.least_order(bars(spark, d).select("ticker", "date", F.log("close").alias("x")), "x")


@query("win16")
def win16(spark, d):
    """Later bars differenced by the order found on earlier ones."""
    b = bars(spark, d)
    moved = W.frac_diff_by(b.join(win15(spark, d), "ticker"), "close", "d")
    return moved.where("date >= date '2000-05-21'").select("ticker", "date", "d", F.round("frac", 4).alias("frac"))


@query(
    "win21",
    sql(
        """, mk AS (SELECT c.idx, avg(b.open / p.open - 1) AS m FROM (SELECT * FROM bars JOIN calendar USING (date)) b JOIN (SELECT ticker, idx, open FROM bars JOIN calendar USING (date)) p ON p.ticker = b.ticker AND p.idx = b.idx - 1 JOIN calendar c ON c.idx = b.idx GROUP BY 1),
        lv AS (SELECT idx, sum(ln(1 + m)) OVER (ORDER BY idx) AS l FROM mk),
        g AS (SELECT ticker, idx, date, open FROM bars JOIN calendar USING (date))
        SELECT g.ticker, g.date, ROUND(ln(e.open / s.open), 6) AS log_ret, ROUND(le.l - ls.l, 5) AS log_benchmark FROM g JOIN g s ON s.ticker = g.ticker AND s.idx = g.idx + 1 JOIN g e ON e.ticker = g.ticker AND e.idx = g.idx + 11 JOIN lv ls ON ls.idx = g.idx + 1 JOIN lv le ON le.idx = g.idx + 11""",
        "bars", "calendar",
    ),
)
def win21(spark, d):
    """Open-to-open return over ten market days after an event bar, and the compounded benchmark beside it, both as logarithms; no row where a leg is missing."""
    b = bars(spark, d)
    cal = W.calendar(b)
    prev = W.lag_calendar(b, "open", 1, "p").where("p is not null")
    m = prev.groupBy("date").agg(F.log(1 + F.avg(F.col("open") / F.col("p") - 1)).alias("m")).join(cal, "date")
    level = m.select("idx", F.sum("m").over(Window.orderBy("idx")).alias("l"))  # one row a market day
    g = W.lag_calendar(W.lag_calendar(b, "open", -1, "s"), "open", -11, "e").where("s is not null and e is not null").join(F.broadcast(cal), "date")
    ls, le = level.select((F.col("idx") - 1).alias("idx"), F.col("l").alias("ls")), level.select((F.col("idx") - 11).alias("idx"), F.col("l").alias("le"))
    j = g.join(F.broadcast(ls), "idx").join(F.broadcast(le), "idx")
    return j.select("ticker", "date", F.round(F.log(F.col("e") / F.col("s")), 6).alias("log_ret"), F.round(F.col("le") - F.col("ls"), 5).alias("log_benchmark"))
