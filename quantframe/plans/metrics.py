"""Metric queries (MET)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import div
from ..operators import stats as S
from ..sources.market import bars, returns, sql, table
from .registry import query


def book(spark, d):
    return returns(spark, d).groupBy("date").agg(F.avg("ret").alias("b"))


_SHARPE = "coalesce(avg({0}) / nullif(stddev_samp({0}), 0), 0) * sqrt(252)"
_SH = _SHARPE.format("ret")


@query("met01", sql(f"SELECT series_id, ROUND({_SH}, 6) AS sharpe FROM returns GROUP BY 1", "returns"))
def met01(spark, d):
    return returns(spark, d).groupBy("series_id").agg(F.round(S.sharpe(), 6).alias("sharpe"))


_MOM = "SELECT series_id, count(ret) AS n, avg(ret) / stddev_samp(ret) AS sr, skewness(ret) AS sk, kurtosis(ret) AS ku FROM returns GROUP BY 1"
_Z = "(sr - {0} / sqrt(252)) / sqrt(greatest((1 + sr * sr / 2 - sk * sr + ku / 4 * sr * sr) / (n - 1), 1e-12))"


@query("met02", sql(f"SELECT series_id, n, ROUND(sk, 6) AS skew, ROUND(ku, 6) AS kurt, ROUND({_Z.format('0.0')}, 6) AS z FROM ({_MOM})", "returns"))
def met02(spark, d):
    """Up to z; the probability itself goes through `psr`."""
    z = S.psr_z(returns(spark, d), ["series_id"])
    return z.select("series_id", "n", F.round("skew", 6).alias("skew"), F.round("kurt", 6).alias("kurt"), F.round("z", 6).alias("z"))


@query("met03")
def met03(spark, d):
    """Expected best Sharpe ratio of as many trials as a customer's orders are."""
    trials = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("trials"))
    return trials.withColumn("expected_max", S.expected_max("trials"))


# Phi(z) = 1/2 + phi(z) * sum of z^(2k+1) / (2k+1)!!, whose terms are all of one sign
_PHI = "0.5 + sign({0}) * exp(-{0} * {0} / 2) / sqrt(2 * pi()) * list_sum([exp((2 * k + 1) * ln(greatest(abs({0}), 1e-300)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1)) FOR k IN range(200)])"
_DSR = f"""SELECT series_id, n, CASE WHEN n >= 5 THEN {_PHI.format('z')} ELSE 0 END AS dsr FROM (
    SELECT series_id, n, (sr - {S.expected_max_sharpe(50)!r} / sqrt(n - 1)) / sqrt(greatest((1 + sr * sr / 2 - sk * sr + ku / 4 * sr * sr) / (n - 1), 1e-12)) AS z FROM ({_MOM}))"""


@query("met04", sql(f"SELECT series_id, n, ROUND(dsr, 9) AS dsr FROM ({_DSR})", "returns"))
def met04(spark, d):
    return S.deflated_sharpe(returns(spark, d), ["series_id"], 50).select("series_id", "n", F.round("dsr", 9).alias("dsr"))


@query("met05", sql(f"SELECT series_id, dsr > 0.95 AS passes FROM ({_DSR})", "returns"))
def met05(spark, d):
    return S.deflated_sharpe(returns(spark, d), ["series_id"], 50).select("series_id", (F.col("dsr") > 0.95).alias("passes"))


@query("met06", sql(f"SELECT m.series_id, ROUND(p.sharpe, 6) AS sharpe, ROUND({_Z.format('0.62')}, 6) AS z_062 FROM ({_MOM}) m JOIN (SELECT series_id, coalesce(avg(ret) / nullif(stddev_pop(ret), 0), 0) * sqrt(252) AS sharpe FROM returns GROUP BY 1) p USING (series_id)", "returns"))
def met06(spark, d):
    """Population Sharpe ratio, and the z against a fixed annual 0.62."""
    r = returns(spark, d)
    z = S.psr_z(r, ["series_id"], 0.62).select("series_id", F.round("z", 6).alias("z_062"))
    return r.groupBy("series_id").agg(F.round(S.sharpe(population=True), 6).alias("sharpe")).join(z, "series_id")


_NAV = "(SELECT series_id, date, ret, exp(sum(ln(1 + ret)) OVER w) AS nav FROM returns WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING))"
_DD = f"SELECT series_id, ROUND(max(1 - nav / greatest(top, {{0}})), 6) AS max_drawdown FROM (SELECT *, max(nav) OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS top FROM {_NAV}) GROUP BY 1"


@query("met07", sql(_DD.format("1.0"), "returns"))
def met07(spark, d):
    return S.drawdown(returns(spark, d)).withColumn("max_drawdown", F.round("max_drawdown", 6))


@query("met08", sql(f"SELECT series_id, max_drawdown < 0.3 AS passes FROM ({_DD.format('1.0')})", "returns"))
def met08(spark, d):
    return S.drawdown(returns(spark, d)).select("series_id", (F.round("max_drawdown", 6) < 0.3).alias("passes"))


@query("met09", sql(_DD.format("0.0"), "returns"))
def met09(spark, d):
    return S.drawdown(returns(spark, d), anchored=False).withColumn("max_drawdown", F.round("max_drawdown", 6))


@query("met10", sql("SELECT series_id, count(ret) AS n, ROUND(sum(ln(1 + ret)), 5) AS log_total, ROUND(exp(sum(ln(1 + ret)) * 252 / count(ret)) - 1, 6) AS cagr, ROUND(stddev_samp(ret) * sqrt(252), 6) AS vol FROM returns GROUP BY 1", "returns"))
def met10(spark, d):
    g = S.growth(returns(spark, d))
    return g.select("series_id", "n", F.round(F.log(1 + F.col("total")), 5).alias("log_total"), F.round("cagr", 6).alias("cagr"), F.round("vol", 6).alias("vol"))


@query("met11", sql("SELECT series_id, date, ROUND(ret - CASE WHEN day(date) % 3 = 0 THEN 0.5 ELSE 0 END * 11 / 1e4, 8) AS net, ROUND(ret - CASE WHEN day(date) % 3 = 0 THEN 0.5 ELSE 0 END * 22 / 1e4, 8) AS stressed FROM returns", "returns"))
def met11(spark, d):
    r = returns(spark, d)
    t = r.where("day(date) % 3 = 0").select("series_id", "date", F.lit(0.5).alias("turnover"))
    a = S.net_of_costs(r, t)
    b = S.net_of_costs(r, t, stress=2.0).select("series_id", "date", F.col("net").alias("stressed"))
    return a.join(b, ["series_id", "date"]).select("series_id", "date", F.round("net", 8).alias("net"), F.round("stressed", 8).alias("stressed"))


_OLS = """SELECT series_id, n, my - beta * mx AS alpha, beta, s2, mx, sxx, (my - beta * mx) / sqrt(s2 * (1.0 / n + mx * mx / sxx)) AS alpha_t, beta / sqrt(s2 / sxx) AS beta_t FROM (
    SELECT *, (syy - beta * sxy) / (n - 2) AS s2 FROM (SELECT series_id, count(*) AS n, avg({0}) AS mx, avg(ret) AS my, regr_sxx(ret, {0}) AS sxx, regr_syy(ret, {0}) AS syy, regr_sxy(ret, {0}) AS sxy, regr_sxy(ret, {0}) / regr_sxx(ret, {0}) AS beta FROM {1} GROUP BY 1))"""
_BOOKED = "(SELECT r.series_id, r.date, r.ret, k.b FROM returns r JOIN book k USING (date))"


@query("met12", sql(f"SELECT series_id, n, ROUND(alpha, 8) AS alpha, ROUND(beta, 6) AS beta, ROUND(alpha_t, 5) AS alpha_t, ROUND(beta_t, 4) AS beta_t FROM ({_OLS.format('b', _BOOKED)})", "returns", "book"))
def met12(spark, d):
    f = S.simple_ols(returns(spark, d).join(F.broadcast(book(spark, d)), "date"), ["series_id"], "ret", "b")
    return f.select("series_id", "n", F.round("alpha", 8).alias("alpha"), F.round("beta", 6).alias("beta"), F.round("alpha_t", 5).alias("alpha_t"), F.round("beta_t", 4).alias("beta_t"))


@query(
    "met13",
    sql(
        f"""SELECT o.series_id, o.n, ROUND(o.alpha * 252, 6) AS alpha, ROUND(o.beta, 6) AS beta, ROUND(o.alpha / sqrt(o.s2 * (o.n - 2) / (o.n - 1)) * sqrt(252), 5) AS ir, ROUND(a.active, 6) AS active, ROUND(a.tracking, 6) AS tracking
        FROM ({_OLS.format('b', _BOOKED)}) o JOIN (SELECT series_id, avg(ret - b) * 252 AS active, stddev_samp(ret - b) * sqrt(252) AS tracking FROM {_BOOKED} GROUP BY 1) a USING (series_id)""",
        "returns", "book",
    ),
)
def met13(spark, d):
    b = S.benchmark_alpha(returns(spark, d), book(spark, d))
    return b.select("series_id", "n", *[F.round(c, 5 if c == "ir" else 6).alias(c) for c in ("alpha", "beta", "ir", "active", "tracking")])


def factors(spark, d):
    """Five factors: means of five groups of series, less the market for all but the first."""
    r = returns(spark, d).withColumn("g", F.substring("series_id", 7, 2).cast("int") % 5)
    f = r.groupBy("date").agg(*[F.coalesce(F.avg(F.when(F.col("g") == k, F.col("ret"))), F.lit(0.0)).alias(f"f{k}") for k in range(5)])
    return f.withColumn("rf", F.lit(0.0001))


@query("met14")
def met14(spark, d):
    """Five-factor alpha with lagged factors."""
    names = [f"f{k}" for k in range(5)]
    a = S.factor_alpha(returns(spark, d), factors(spark, d), names)
    return a.select("series_id", "n", F.round("alpha", 6).alias("alpha"), F.round("alpha_t", 4).alias("alpha_t"), F.transform("betas", lambda x: F.round(x, 5)).alias("betas"))


_REG = "reg AS (SELECT date, CASE WHEN s > 0.0517 THEN 'bull' WHEN s < -0.0517 THEN 'bear' ELSE 'sideways' END AS trend, CASE WHEN abs(b) > 0.0123 THEN 'high' ELSE 'low' END AS vol FROM (SELECT date, b, sum(b) OVER (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS s FROM book))"


@query("met15", sql("", "returns", "book").rstrip() + f", {_REG} SELECT series_id, trend, vol, count(*) AS n_days, ROUND({_SH}, 6) AS sharpe, ROUND(avg(ret), 8) AS mean_ret FROM returns JOIN reg USING (date) GROUP BY GROUPING SETS ((series_id, trend), (series_id, vol))")
def met15(spark, d):
    """Both regime families in one pass of grouping sets."""
    s = F.sum("b").over(Window.orderBy("date").rowsBetween(-20, 0))
    k = book(spark, d).withColumn("s", s)
    reg = k.select("date", F.when(F.col("s") > 0.0517, "bull").when(F.col("s") < -0.0517, "bear").otherwise("sideways").alias("trend"), F.when(F.abs("b") > 0.0123, "high").otherwise("low").alias("vol"))
    j = returns(spark, d).join(F.broadcast(reg), "date")
    return j.groupingSets([["series_id", "trend"], ["series_id", "vol"]], "series_id", "trend", "vol").agg(F.count(F.lit(1)).alias("n_days"), F.round(S.sharpe(), 6).alias("sharpe"), F.round(F.avg("ret"), 8).alias("mean_ret"))


@query("met16", sql(f"SELECT series_id, ROUND({_SHARPE.format('e')}, 5) AS marginal_sharpe FROM (SELECT series_id, ret - beta * b AS e FROM {_BOOKED} JOIN (SELECT series_id, sum(ret * b) / sum(b * b) AS beta FROM {_BOOKED} GROUP BY 1) USING (series_id)) GROUP BY 1", "returns", "book"))
def met16(spark, d):
    return S.marginal_sharpe(returns(spark, d), book(spark, d)).select("series_id", F.round("marginal_sharpe", 5).alias("marginal_sharpe"))


@query("met17", sql("SELECT date, ROUND(0.8 * b + 0.2 * ret, 8) AS ret FROM book JOIN (SELECT date, ret FROM returns WHERE series_id = 'Brand#1') USING (date)", "book"))
def met17(spark, d):
    return S.blend(book(spark, d), returns(spark, d).where("series_id = 'Brand#1'").select("date", "ret"), 0.2).select("date", F.round("ret", 8).alias("ret"))


_LOO = "(SELECT *, (sum(ret) OVER (PARTITION BY date) - ret) / nullif(count(*) OVER (PARTITION BY date) - 1, 0) AS others FROM returns)"
_LOOX = f"(SELECT * FROM {_LOO} WHERE others IS NOT NULL)"


@query("met18", sql(f"SELECT series_id, n, ROUND(alpha_t, 5) AS alpha_t, n < 30 OR alpha_t >= 1.75 AS passes FROM ({_OLS.format('b', _BOOKED)})", "returns", "book"))
def met18(spark, d):
    """Marginal-alpha gate with 25 active: thin overlap passes."""
    f = S.simple_ols(returns(spark, d).join(F.broadcast(book(spark, d)), "date"), ["series_id"], "ret", "b", 1)
    return f.select("series_id", "n", F.round("alpha_t", 5).alias("alpha_t"), ((F.col("n") < 30) | (F.col("alpha_t") >= S.min_alpha_t(25))).alias("passes"))


@query("met19", sql(f"SELECT series_id, n, ROUND(alpha_t, 5) AS alpha_t, ROUND(beta, 6) AS beta FROM ({_OLS.format('others', _LOOX)})", "returns"))
def met19(spark, d):
    f = S.simple_ols(S.leave_one_out(returns(spark, d)), ["series_id"], "ret", "others", 1)
    return f.select("series_id", "n", F.round("alpha_t", 5).alias("alpha_t"), F.round("beta", 6).alias("beta"))


_WALK = """WITH RECURSIVE {0}, size AS (SELECT count(DISTINCT series_id) AS total FROM returns),
    walk AS (
        SELECT 0 AS step, (SELECT list(DISTINCT series_id) FROM returns) AS kept, CAST(NULL AS VARCHAR) AS gone, CAST(NULL AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS alpha_t
        UNION ALL
        SELECT step + 1, list_filter(kept, lambda x: x <> series_id), series_id, n, alpha_t
        FROM (SELECT *, row_number() OVER (ORDER BY alpha_t, series_id) AS k FROM ({1})) JOIN (SELECT step, kept FROM walk) ON true
        WHERE k = 1 AND n >= 30 AND len(kept) > 1 AND alpha_t < (SELECT greatest(0.5, 2 - 0.01 * total) FROM size)),
    last AS (SELECT arg_max(kept, step) AS kept FROM walk), left_over AS (SELECT r.* FROM returns r JOIN last ON list_contains(last.kept, r.series_id))
    SELECT gone AS series_id, step, n, ROUND(alpha_t, 5) AS alpha_t FROM walk WHERE gone IS NOT NULL
    UNION ALL SELECT u.series_id, 0, coalesce(f.n, 0), ROUND(CASE WHEN f.n >= 30 THEN f.alpha_t END, 5) FROM (SELECT unnest(kept) AS series_id FROM last) u LEFT JOIN ({2}) f USING (series_id)"""
_LEFT = "(SELECT series_id, ret, (sum(ret) OVER w - ret) / nullif(count(ret) OVER w - 1, 0) AS others FROM {0} WINDOW w AS (PARTITION BY date) QUALIFY others IS NOT NULL)"


def _walk_sql() -> str:
    given = sql("", "returns").strip().removeprefix("WITH ")
    kept = "(SELECT r.* FROM walk JOIN returns r ON list_contains(walk.kept, r.series_id))"
    return _WALK.format(given, _OLS.format("others", _LEFT.format(kept)), _OLS.format("others", _LEFT.format("left_over")))


@query("met20", _walk_sql())
def met20(spark, d):
    """Backward elimination with the gate of all series: the round each series goes in, 0 for those that stay."""
    return S.backward_elimination(returns(spark, d)).select("series_id", F.coalesce("step", F.lit(0)).alias("step"), "n", F.round("alpha_t", 5).alias("alpha_t"))


_POOL = "pool AS (SELECT 'Brand#1' AS series_id, date, ret FROM returns WHERE series_id = 'Brand#1' AND date < DATE '2000-01-01' UNION ALL SELECT 'Brand#1', date, ret / 2 FROM returns WHERE series_id = 'Brand#1' AND date >= DATE '2000-01-01')"


@query("met21", sql("", "returns", "book").rstrip() + f", {_POOL} SELECT series_id, n, ROUND(alpha * 252, 6) AS alpha, ROUND(alpha_t, 5) AS alpha_t FROM ({_OLS.format('b', '(SELECT series_id, ret, b FROM pool JOIN book USING (date))')})")
def met21(spark, d):
    """Alpha over two windows pooled; the later window wins where both have a date."""
    r = returns(spark, d).where("series_id = 'Brand#1'")
    late = r.where("date >= date '2000-01-01'").withColumn("ret", F.col("ret") / 2)
    both = r.withColumn("p", F.lit(1)).unionByName(late.withColumn("p", F.lit(0)))
    pool = both.groupBy("series_id", "date").agg(F.min_by("ret", "p").alias("ret"))
    b = S.benchmark_alpha(pool, book(spark, d))
    return b.select("series_id", "n", F.round("alpha", 6).alias("alpha"), F.round("alpha_t", 5).alias("alpha_t"))


def _gate_sql(reasons: str) -> str:
    return f"SELECT series_id, len(reasons) = 0 AS passes, array_to_string(reasons, ',') AS reasons FROM (SELECT series_id, list_filter([{reasons}], lambda x: x IS NOT NULL) AS reasons FROM m)"


_M = f"m AS (SELECT o.series_id, o.n, o.alpha, o.alpha_t, dd.max_drawdown FROM ({_OLS.format('b', _BOOKED)}) o JOIN ({_DD.format('1.0')}) dd USING (series_id))"


@query("met22", sql("", "returns", "book").rstrip() + f", {_M} " + _gate_sql("CASE WHEN alpha_t < 2 THEN 'pooled t' END, CASE WHEN alpha <= 0 THEN 'alpha' END, CASE WHEN max_drawdown >= 0.3 THEN 'drawdown' END, CASE WHEN n < 1800 THEN 'bars' END"))
def met22(spark, d):
    r = returns(spark, d)
    m = S.benchmark_alpha(r, book(spark, d)).join(S.drawdown(r), "series_id")
    rules = [(F.col("alpha_t") < 2, "pooled t"), (F.col("alpha") <= 0, "alpha"), (F.round("max_drawdown", 6) >= 0.3, "drawdown"), (F.col("n") < 1800, "bars")]
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))
    return m.select("series_id", (F.size(reasons) == 0).alias("passes"), F.array_join(reasons, ",").alias("reasons"))


_IR = "alpha / sqrt(s2 * (n - 2) / (n - 1)) * sqrt(252)"


@query("met23", sql(f"SELECT series_id, ROUND(log10(pow(2 / nullif({_IR}, 0), 2) * 252), 4) AS log_days FROM ({_OLS.format('b', _BOOKED)})", "returns", "book"))
def met23(spark, d):
    """Bars until an alpha of this information ratio is significant (as its logarithm)."""
    b = S.benchmark_alpha(returns(spark, d), book(spark, d))
    return b.select("series_id", F.round(F.log10(F.pow(div(F.lit(2.0), "ir"), F.lit(2.0)) * 252), 4).alias("log_days"))


@query(
    "met24",
    sql("", "returns", "book").rstrip()
    + f""", {_M}, zs AS (SELECT series_id, n AS bars, {_Z.format('0.62')} AS z FROM ({_MOM})),
    act AS (SELECT series_id, count(*) FILTER (WHERE ret <> 0) AS active FROM returns GROUP BY 1)
    SELECT series_id, bars >= 50 AND z > 0.38532046640756773 AND max_drawdown < 0.3 AND active >= 50 AND alpha_t >= 2 AS go FROM m JOIN zs USING (series_id) JOIN act USING (series_id)""",
)  # a probability over 0.65 is a z over its normal quantile
def met24(spark, d):
    """Go / no-go: enough bars and activity, probable Sharpe, drawdown, significant alpha."""
    r = returns(spark, d)
    m = S.psr(r, ["series_id"], 0.62).select("series_id", "n", "psr").join(S.drawdown(r), "series_id").join(S.benchmark_alpha(r, book(spark, d)).select("series_id", "alpha_t"), "series_id")
    act = r.groupBy("series_id").agg(F.count_if(F.col("ret") != 0).alias("active"))
    return m.join(act, "series_id").select("series_id", ((F.col("n") >= 50) & (F.col("psr") > 0.65) & (F.col("max_drawdown") < 0.30) & (F.col("active") >= 50) & (F.col("alpha_t") >= 2)).alias("go"))


@query("met25", "SELECT s_suppkey, CASE WHEN new < 0.95 THEN 'FAIL' WHEN (old - new) / greatest(abs(old), 0.01) > 0.5 THEN 'DEGRADED' ELSE 'OK' END AS status FROM (SELECT s_suppkey, s_acctbal / 1000 AS new, s_suppkey % 13 AS old FROM supplier)")
def met25(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("new"), (F.col("s_suppkey") % 13).alias("old"))
    lost = (F.col("old") - F.col("new")) / F.greatest(F.abs("old").cast("double"), F.lit(0.01))
    return s.select("s_suppkey", F.when(F.col("new") < 0.95, "FAIL").when(lost > 0.5, "DEGRADED").otherwise("OK").alias("status"))


@query("met26", "SELECT o_orderkey, ROUND(least(greatest(o_totalprice, lo), hi), 3) AS o_totalprice FROM orders, (SELECT quantile_cont(o_totalprice, 0.01::DOUBLE) AS lo, quantile_cont(o_totalprice, 0.99::DOUBLE) AS hi FROM orders)")
def met26(spark, d):
    return S.winsorize(table(spark, d, "orders"), "o_totalprice").select("o_orderkey", F.round("o_totalprice", 3).alias("o_totalprice"))


@query("met27")
def met27(spark, d):
    """Regression with errors clustered by day."""
    b = bars(spark, d).withColumn("day", F.col("close") / F.col("open") - 1).withColumn("size", F.log(F.col("volume"))).withColumn("span", F.col("high") / F.col("low") - 1)
    out = S.cluster_ols(b, "day", ["size", "span"], "date") or {"coefs": [], "tstats": [], "n": 0, "clusters": 0}
    rows = [(k, out["coefs"][k], out["tstats"][k], out["n"], out["clusters"]) for k in range(len(out["coefs"]))]
    return spark.createDataFrame(rows, "term int, coef double, t double, n long, clusters long")


@query("met28", sql("SELECT ROUND((avg(x) - avg(y)) / sqrt(var_samp(x) / count(x) + var_samp(y) / count(y)), 5) AS t, ROUND(avg(ret) / (stddev_samp(ret) / sqrt(count(ret))), 5) AS mean_t FROM (SELECT ret, CASE WHEN series_id = 'Brand#1' THEN ret END AS x, CASE WHEN series_id <> 'Brand#1' THEN ret END AS y FROM returns)", "returns"))
def met28(spark, d):
    r = returns(spark, d)
    t = S.welch_t(r, "ret", F.col("series_id") == "Brand#1").select(F.round("t", 5).alias("t"))
    return t.crossJoin(r.agg(F.round(S.mean_t("ret"), 5).alias("mean_t")))


@query("met29")
def met29(spark, d):
    """Unit-root test of each series' log value; lag-1 autocorrelation."""
    r = returns(spark, d)
    w = Window.partitionBy("series_id").orderBy("date")
    lagged = r.withColumn("p", F.lag("ret").over(w))
    auto = lagged.groupBy("series_id").agg(F.round(F.corr("ret", "p"), 6).alias("autocorr"))
    value = r.select("series_id", "date", F.sum(F.log1p("ret")).over(w).alias("x"))
    return S.unit_roots(value, ["series_id"], "date", "x").select("series_id", F.col("p").alias("adf_p")).join(auto, "series_id")


@query("met30", sql("SELECT series_id, ROUND(CASE WHEN c < 20 OR f IS NULL THEN 1.0 ELSE least(greatest(f, 0), 2) END, 5) AS leverage FROM (SELECT series_id, count(ret) AS c, avg(ret) / nullif(var_samp(ret), 0) AS f FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS k FROM returns) WHERE k <= 63 GROUP BY 1)", "returns"))
def met30(spark, d):
    return S.kelly(returns(spark, d)).select("series_id", F.round("leverage", 5).alias("leverage"))


@query("met31", sql(f"SELECT series_id, ROUND(b.s / nullif(a.s, 0), 4) AS decay FROM (SELECT series_id, {_SH} AS s FROM returns WHERE date < DATE '2000-05-21' GROUP BY 1) a JOIN (SELECT series_id, {_SH} AS s FROM returns WHERE date >= DATE '2000-05-21' GROUP BY 1) b USING (series_id)", "returns"))
def met31(spark, d):
    """Out-of-sample over in-sample Sharpe ratio."""
    early = F.col("date") < "2000-05-21"
    one = returns(spark, d).groupBy("series_id").agg(S.sharpe(F.when(early, F.col("ret"))).alias("a"), S.sharpe(F.when(~early, F.col("ret"))).alias("b"))
    return one.select("series_id", F.round(div("b", "a"), 4).alias("decay"))
