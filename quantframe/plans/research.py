"""Catalog, library, gate and report queries (RES, LIB, LOP, REP)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import catalog as K
from ..operators import stats as S
from ..operators import windows as W
from ..operators.joins import asof
from ..sources.market import bars, returns, sql, table
from .metrics import _LOOX, _OLS
from .registry import query

YEAR = W.YEAR
BY = "OVER (PARTITION BY ticker ORDER BY date)"
_FRAME = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
_FITTED = "|".join(K.FITTED_PHRASES)


@query(
    "res01",
    f"""SELECT doc_id, array_to_string(list_filter([CASE WHEN len([w for w in string_split_regex(text, '\\s+') if w <> '']) < 20 THEN 'short' END, CASE WHEN regexp_matches(lower(text), '{_FITTED}') THEN 'fitted' END, CASE WHEN lang NOT IN ('momentum', 'value', 'quality', 'macro', 'en') THEN 'cohort' END], lambda x: x IS NOT NULL), ',') AS faults FROM documents""",
)
def res01(spark, d):
    """Hypothesis checks over texts; a language stands for the cohort."""
    docs = table(spark, d, "documents").withColumn("cohort", F.when(F.col("lang") == "en", "macro").otherwise(F.col("lang")))
    return docs.select("doc_id", F.array_join(K.knowledge_faults("text", "cohort"), ",").alias("faults"))


def hypotheses(spark, d):
    """Orders as hypotheses: id, trial number, status, Sharpe, refinements, cohort."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"), (k % 100_000).alias("trial_number"), F.element_at(F.array(*map(F.lit, ("pending", "accepted", "rejected", "active"))), (k % 4 + 1).cast("int")).alias("status"),
        (F.col("o_totalprice") / 100_000).alias("sharpe"), (k % 5).alias("refinement_count"), F.element_at(F.array(*map(F.lit, K.COHORTS)), (k % 3 + 1).cast("int")).alias("cohort"),
    )


_HYP = "hypotheses AS (SELECT o_orderkey AS id, o_orderkey % 100000 AS trial_number, ['pending', 'accepted', 'rejected', 'active'][o_orderkey % 4 + 1] AS status, o_totalprice / 100000 AS sharpe, o_orderkey % 5 AS refinement_count, ['momentum', 'value', 'quality'][o_orderkey % 3 + 1] AS cohort FROM orders)"


@query("res02", f"WITH {_HYP} SELECT coalesce(max(trial_number), 0) + 1 AS next FROM hypotheses")
def res02(spark, d):
    return K.next_trial(hypotheses(spark, d))


@query("res03", f"WITH {_HYP} SELECT id, CASE WHEN id % 7 = 0 THEN 'error' ELSE status END AS status FROM hypotheses")
def res03(spark, d):
    """Status changes as an upsert by id."""
    h = hypotheses(spark, d).select("id", "status")
    return K.upsert(h, h.where("id % 7 = 0").withColumn("status", F.lit("error")), ["id"])


query("snk06", f"WITH {_HYP} SELECT id, CASE WHEN id % 7 = 0 THEN 'error' ELSE status END AS status FROM hypotheses")(res03)


@query("res04", sql("SELECT date, ROUND(avg(ret), 8) AS ret, count(*) AS members FROM returns WHERE CAST(substr(series_id, 7) AS INTEGER) % 2 = 0 GROUP BY 1", "returns"))
def res04(spark, d):
    """Book as the equal-weight mean of accepted series."""
    r = returns(spark, d).where(F.substring("series_id", 7, 2).cast("int") % 2 == 0)
    return r.groupBy("date").agg(F.round(F.avg("ret"), 8).alias("ret"), F.count(F.lit(1)).alias("members"))


@query("res05", sql("SELECT series_id, date, ret FROM returns", "returns"))
def res05(spark, d):
    """Series stored as arrays and read back."""
    return K.unpack_series(K.pack_series(returns(spark, d), "series_id"), "series_id")


@query("jon19", f"WITH {_HYP} SELECT id, cohort, l_linenumber FROM lineitem JOIN hypotheses ON id = l_orderkey WHERE status IN ('accepted', 'active')")
def jon19(spark, d):
    h = hypotheses(spark, d).where(F.col("status").isin("accepted", "active")).select("id", "cohort")
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber")
    return t.join(h, "id").select("id", "cohort", "l_linenumber")


@query("res06", f"WITH {_HYP} SELECT cohort, count(*) FILTER (WHERE status = 'active') AS active, arg_max(id, (sharpe, id)) FILTER (WHERE status = 'rejected' AND refinement_count < 2) AS pending_refinement FROM hypotheses GROUP BY 1")
def res06(spark, d):
    h = hypotheses(spark, d)
    open_ = F.when((F.col("status") == "rejected") & (F.col("refinement_count") < 2), F.struct("sharpe", "id"))
    return h.groupBy("cohort").agg(F.count_if(F.col("status") == "active").alias("active"), F.max(open_)["id"].alias("pending_refinement"))


def library(spark, d):
    return table(spark, d, "part").select("p_brand").distinct().select(F.col("p_brand").alias("name"), F.when(F.substring("p_brand", 7, 2).cast("int") % 6 == 0, "dead").otherwise("active").alias("status"), F.lit(1.0).alias("weight"), (F.substring("p_brand", 7, 2).cast("int") * 10).cast("long").alias("days_at_floor"))


_LIB = "library AS (SELECT DISTINCT p_brand AS name, CASE WHEN CAST(substr(p_brand, 7) AS INTEGER) % 6 = 0 THEN 'dead' ELSE 'active' END AS status, CAST(1.0 AS DOUBLE) AS weight, CAST(substr(p_brand, 7) AS BIGINT) * 10 AS days_at_floor FROM part)"


@query("lib01", f"WITH {_LIB} SELECT name, status, weight FROM library UNION ALL SELECT 'new', 'active', 1.0::DOUBLE")
def lib01(spark, d):
    """Registering ignores names that are there."""
    lib = library(spark, d).select("name", "status", "weight")
    new = spark.createDataFrame([("new", "active", 1.0), ("Brand#1", "active", 9.0)], "name string, status string, weight double")
    return K.upsert(lib, new, ["name"], replace=False)


@query("lib02", f"WITH {_LIB}, act AS (SELECT name FROM library WHERE name <> 'Brand#3' UNION ALL SELECT 'new') SELECT coalesce(l.name, a.name) AS name, CASE WHEN a.name IS NULL THEN 'dead' WHEN l.name IS NULL THEN 'active' ELSE l.status END AS status, coalesce(l.weight, 1.0) AS weight FROM library l FULL JOIN act a ON l.name = a.name")
def lib02(spark, d):
    lib = library(spark, d)
    active = lib.where("name <> 'Brand#3'").select("name").union(spark.createDataFrame([("new",)], "name string"))
    return K.sync_active(lib, active)


_SR = "SELECT series_id, count(ret) AS c, coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0) * sqrt(252) AS sr FROM returns WHERE date BETWEEN DATE '2000-03-06' AND DATE '2000-06-01' GROUP BY 1"


@query(
    "lib03",
    sql("", "returns").rstrip()
    + f""", {_LIB}, s AS ({_SR}), w AS (SELECT name, status, days_at_floor, sr, CASE WHEN sr IS NULL THEN weight ELSE least(greatest(sr / 0.5, 0.3), 2.5) END AS w FROM library LEFT JOIN s ON series_id = name AND c >= 10),
    x AS (SELECT *, CASE WHEN sr IS NULL THEN days_at_floor WHEN w <= 0.3 THEN days_at_floor + 1 ELSE 0 END AS days FROM w)
    SELECT name, ROUND(w, 6) AS weight, days AS days_at_floor, CASE WHEN days >= 126 THEN 'dead' WHEN days >= 63 THEN 'decayed' WHEN status = 'dead' THEN 'dead' ELSE 'active' END AS status FROM x""",
)
def lib03(spark, d):
    """Weights by the Sharpe ratio of 63 business days; floor days counted."""
    u = K.update_weights(library(spark, d), returns(spark, d), "2000-06-01")
    return u.select("name", F.round("weight", 6).alias("weight"), "days_at_floor", "status")


_LIVES = "(SELECT series_id, date, ret FROM returns WHERE CASE CAST(substr(series_id, 7) AS INTEGER) % 3 WHEN 0 THEN date >= DATE '1999-01-01' WHEN 2 THEN date < DATE '1995-12-01' ELSE true END)"


@query(
    "lib04",
    sql("", "returns").rstrip()
    + f""", lives AS {_LIVES},
    f AS (SELECT date, coalesce(avg(ret) FILTER (WHERE CAST(substr(series_id, 7) AS INTEGER) % 5 = 0), 0) AS f0, coalesce(avg(ret) FILTER (WHERE CAST(substr(series_id, 7) AS INTEGER) % 5 = 1), 0) AS f1, 0.0001 AS rf
          FROM returns WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY date),
    b AS (SELECT date, avg(ret) AS b FROM returns WHERE date >= DATE '1996-01-01' GROUP BY date),
    j AS (SELECT l.*, f0, f1, ret - rf AS y, b FROM lives l LEFT JOIN f USING (date) LEFT JOIN b USING (date)),
    m AS (SELECT series_id, count(y) AS nf, count(b) AS nb, regr_sxx(y, f0) AS s11, regr_sxx(y, f1) AS s22, regr_sxy(f1, f0) FILTER (WHERE y IS NOT NULL) AS s12, regr_sxy(y, f0) AS s1y, regr_sxy(y, f1) AS s2y,
                 regr_sxy(ret, b) / nullif(regr_sxx(ret, b), 0) AS beta FROM j GROUP BY series_id),
    k AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b0, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b1,
                 CASE WHEN nf >= 60 THEN 'factors' WHEN nb >= 20 AND beta IS NOT NULL THEN 'benchmark' ELSE 'raw' END AS method FROM m)
    SELECT * FROM (SELECT series_id, date, method, ROUND(CASE method WHEN 'factors' THEN y - b0 * f0 - b1 * f1 WHEN 'benchmark' THEN ret - beta * b ELSE ret END, 7) AS residual FROM j JOIN k USING (series_id)) WHERE residual IS NOT NULL""",
)
def lib04(spark, d):
    """Residual returns of series: over factors where they cover it, else over the benchmark, else as they are; factors end early, the benchmark begins late, and a third of the series end or begin between them."""
    r = returns(spark, d)
    number = F.substring("series_id", 7, 2).cast("int")
    lives = r.where(F.when(number % 3 == 0, F.col("date") >= "1999-01-01").when(number % 3 == 2, F.col("date") < "1995-12-01").otherwise(F.lit(True)))
    group = lambda k: F.coalesce(F.avg(F.when(number % 5 == k, F.col("ret"))), F.lit(0.0)).alias(f"f{k}")
    factors = r.where("date between '1996-01-01' and '1997-12-31'").groupBy("date").agg(group(0), group(1)).withColumn("rf", F.lit(0.0001))
    bench = r.where("date >= '1996-01-01'").groupBy("date").agg(F.avg("ret").alias("b"))
    return S.residual_returns(lives, factors, ["f0", "f1"], bench).withColumn("residual", F.round("residual", 7))


PROPOSED = ("ret_21d", "-ret_21d", "-gap_1d")  # expressions that a proposer returned


@query("lop01")
def lop01(spark, d):
    """One round of the search over given expressions: checked, scored, backtested from the next open, gated on activity and marginal alpha. All expressions are one plan: a bar gives a row for each."""
    from ..operators import execution as X
    from ..operators.clean import top_quantile

    b = W.gap(W.lookback_returns(bars(spark, d), (21,)))
    book = returns(spark, d).groupBy("date").agg(F.avg("ret").alias("b"))
    scores = [F.struct(F.lit(f"h{k}").alias("run"), K.checked_expression(spark, text, ["ret_21d", "gap_1d", "close"]).alias("score")) for k, text in enumerate(PROPOSED)]
    days = b.select("date").distinct()
    first = days.groupBy(F.trunc("date", "month").alias("m")).agg(F.min("date").alias("date")).select("date")
    scored = b.join(F.broadcast(first), "date").select("date", "ticker", F.explode(F.array(*scores)).alias("x")).select("date", "ticker", "x.*").where("score is not null")
    picks = top_quantile(scored, "score", ["run", "date"]).select("run", "date", "ticker", "weight")
    # a decision holds until the next of its run
    decided = picks.select("run", "date").distinct()
    calendar = decided.select("run").distinct().join(days, how="cross")  # runs are as many as expressions
    at = asof(calendar, decided.withColumnRenamed("date", "decided"), ["run"], "date", "decided", ["decided"]).where("decided is not null")
    held = at.join(picks.withColumnRenamed("date", "decided"), ["run", "decided"]).join(b.select("date", "ticker"), ["date", "ticker"], "left_semi")
    r = X.nav_returns(X.backtest(X.normalise(held.select("run", "date", "ticker", "weight")), b))
    act = r.groupBy("series_id").agg(F.count_if(F.col("ret") != 0).alias("active_days"))
    fit = S.simple_ols(r.join(F.broadcast(book), "date"), ["series_id"], "ret", "b", 30).select("series_id", F.round("alpha_t", 4).alias("alpha_t"))
    return act.join(fit, "series_id").withColumn("accepted", (F.col("active_days") >= 50) & (F.col("alpha_t") >= S.min_alpha_t(0)))


@query("lop03", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id AS VARCHAR) END AS id FROM documents")
def lop03(spark, d):
    """JSON out of fenced model output."""
    k = F.col("doc_id").cast("string")
    text = F.when(F.col("doc_id") % 3 == 0, F.lit("no object here")).otherwise(F.concat(F.lit('Sure:\n```json\n{"id": "'), k, F.lit('", "x": {"y": 1}}\n```\ndone')))
    docs = table(spark, d, "documents").select("doc_id", K.extract_json(text).alias("j"))
    return docs.select("doc_id", F.get_json_object("j", "$.id").alias("id"))


@query("rep01", sql("SELECT date, CASE WHEN day(date) <= 3 AND isodow(date) < 6 AND (day(date) = 1 OR isodow(date) = 1) THEN CASE WHEN month(date) IN (1, 4, 7, 10) THEN 'quarterly' ELSE 'monthly' END WHEN isodow(date) = 5 THEN 'weekly' ELSE 'daily' END AS level FROM calendar", "calendar"))
def rep01(spark, d):
    """Report level of a day: the first weekday of a quarter or month, Fridays, other days."""
    wd, day = F.weekday("date"), F.day("date")
    first = (day <= 3) & (wd < 5) & ((day == 1) | (wd == 0))
    level = F.when(first & F.month("date").isin(1, 4, 7, 10), "quarterly").when(first, "monthly").when(wd == 4, "weekly").otherwise("daily")
    return bars(spark, d).select("date").distinct().select("date", level.alias("level"))


@query("rep02", sql("SELECT series_id, ROUND(exp(sum(ln(1 + ret))) - 1, 6) AS total FROM returns WHERE date > DATE '2001-01-01' GROUP BY 1", "returns"))
def rep02(spark, d):
    """Compounding after a start date."""
    g = S.growth(returns(spark, d).where("date > date '2001-01-01'"))
    return g.select("series_id", F.round("total", 6).alias("total"))


_PARITY = {"rsi": "rsi_14 rsi_15", "vol": "vol_21d vol_22d", "from_high": "high_63 high_2", "ret_5d": "ret_5d warm_5d"}


@query(
    "rep03",
    sql("", "bars").rstrip()
    + f""", x AS (SELECT *, close - lag(close) {BY} AS d1, close / lag(close) {BY} - 1 AS r, close / lag(close, 5) {BY} - 1 AS ret_5d FROM bars),
    f AS (SELECT ticker, date, ret_5d, ret_5d AS warm_5d,
        CASE WHEN count(d1) {_FRAME.format(13)} = 14 THEN 100 - 100 / (1 + avg(greatest(d1, 0)) {_FRAME.format(13)} / nullif(avg(greatest(-d1, 0)) {_FRAME.format(13)}, 0)) END AS rsi_14,
        CASE WHEN count(d1) {_FRAME.format(14)} = 15 THEN 100 - 100 / (1 + avg(greatest(d1, 0)) {_FRAME.format(14)} / nullif(avg(greatest(-d1, 0)) {_FRAME.format(14)}, 0)) END AS rsi_15,
        CASE WHEN count(r) {_FRAME.format(20)} = 21 THEN stddev_samp(r) {_FRAME.format(20)} * sqrt(252) END AS vol_21d, CASE WHEN count(r) {_FRAME.format(21)} = 22 THEN stddev_samp(r) {_FRAME.format(21)} * sqrt(252) END AS vol_22d,
        CASE WHEN count(close) {_FRAME.format(251)} >= 63 THEN close / max(close) {_FRAME.format(251)} - 1 END AS high_63, CASE WHEN count(close) {_FRAME.format(251)} >= 2 THEN close / max(close) {_FRAME.format(251)} - 1 END AS high_2
        FROM x)
    """
    + " UNION ALL ".join(f"SELECT '{k}' AS feature, count(*) AS n, count(*) FILTER (WHERE ({a} IS NULL AND {b} IS NULL) OR coalesce(abs({a} - {b}) < 1e-6, false)) AS matched FROM f" for k, (a, b) in ((k, v.split()) for k, v in _PARITY.items())),
)
def rep03(spark, d):
    """Parity of the panel's features with the incremental path's, which counts its windows otherwise: rows and those within a tolerance, by feature. The returns are computed over the warm-up of an append."""
    from ..sources.files import stored

    b = stored(bars(spark, d), "bars")
    batch = W.from_high(W.volatility(W.rsi(W.lookback_returns(b, (5,)))), YEAR, 63).withColumnRenamed("pct_from_high", "high_63")
    own = W.from_high(W.volatility(W.rsi(b, 15), 22), at_least=2).select("ticker", "date", "rsi_15", "vol_22d", F.col("pct_from_high").alias("high_2"))
    cut = F.lit("2000-06-30").cast("date")
    k = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("date").desc()))
    warm = b.where(F.col("date") <= cut).withColumn("k", k).where("k <= 70").drop("k")
    late = W.lookback_returns(warm.unionByName(b.where(F.col("date") > cut)), (5,)).where(F.col("date") > cut)
    early = W.lookback_returns(b.where(F.col("date") <= cut), (5,))
    again = early.unionByName(late).select("ticker", "date", F.col("ret_5d").alias("warm_5d"))
    both = batch.join(own, ["ticker", "date"]).join(again, ["ticker", "date"])
    same = lambda x, y: (F.col(x).isNull() & F.col(y).isNull()) | F.coalesce(F.abs(F.col(x) - F.col(y)) < 1e-6, F.lit(False))
    counts = F.array(*[F.struct(F.lit(k).alias("feature"), same(*v.split()).alias("same")) for k, v in _PARITY.items()])
    return both.select(F.explode(counts).alias("x")).groupBy(F.col("x.feature").alias("feature")).agg(F.count(F.lit(1)).alias("n"), F.count_if("x.same").alias("matched"))


@query(
    "top07",
    sql(f"SELECT series_id, ROUND(CASE WHEN n >= 30 THEN alpha_t END, 5) AS alpha_t FROM ({_OLS.format('others', _LOOX)}) ORDER BY CASE WHEN n >= 30 THEN alpha_t END NULLS FIRST, series_id LIMIT 1", "returns"),
)
def top07(spark, d):
    """The weakest series against the mean of the others."""
    f = S.simple_ols(S.leave_one_out(returns(spark, d)), ["series_id"], "ret", "others", 30)
    return f.orderBy(F.col("alpha_t").asc_nulls_first(), "series_id").limit(1).select("series_id", F.round("alpha_t", 5).alias("alpha_t"))


@query("str09", sql("SELECT date, ticker, ROUND(close / open - 1, 6) AS score FROM bars WHERE volume > 20", "bars"))
def str09(spark, d):
    """A strategy given as a checked expression over the bar's columns."""
    names = ["open", "high", "low", "close", "volume"]
    score, keep = K.checked_expression(spark, "close / open - 1", names), K.checked_expression(spark, "volume > 20", names)
    return bars(spark, d).where(keep).select("date", "ticker", F.round(score, 6).alias("score"))


query("lop02", sql("SELECT date, ticker, ROUND(close / open - 1, 6) AS score FROM bars WHERE volume > 20", "bars"))(str09)

