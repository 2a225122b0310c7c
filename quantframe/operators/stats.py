"""Evaluation statistics of return series (series_id, date, ret); a NULL return is no observation."""

from __future__ import annotations

from math import e as E_
from math import sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import EULER, col, div, kurt, normal_cdf, skew
from ..sources.files import stored

YEAR = 252


def sharpe(x: str | Column = "ret", population: bool = False) -> Column:
    """Annual Sharpe ratio; 0 without observations or spread."""
    std = F.stddev_pop if population else F.stddev_samp
    return F.coalesce(div(F.avg(col(x)), std(col(x))), F.lit(0.0)) * sqrt(YEAR)


def psr_z(df: DataFrame, by: list[str], annual: float | Column = 0.0, x: str = "ret") -> DataFrame:
    """by with n, sr (per period), skew, kurt and z of the probabilistic Sharpe ratio against an annual benchmark; z is NULL below 5 observations or without spread."""
    m = df.groupBy(*by).agg(F.count(x).alias("n"), div(F.avg(x), F.stddev_samp(x)).alias("sr"), skew(x).alias("skew"), kurt(x).alias("kurt"))
    bench = (annual if isinstance(annual, Column) else F.lit(float(annual))) / sqrt(YEAR)
    var = (1 + F.col("sr") ** 2 / 2 - F.col("skew") * F.col("sr") + F.col("kurt") / 4 * F.col("sr") ** 2) / (F.col("n") - 1)
    return m.withColumn("z", F.when(F.col("n") >= 5, (F.col("sr") - bench) / F.sqrt(F.greatest(var, F.lit(1e-12)))))


def psr(df: DataFrame, by: list[str], annual: float | Column = 0.0) -> DataFrame:
    """psr_z with psr = Phi(z), 0 where z is not known."""
    return psr_z(df, by, annual).withColumn("psr", F.coalesce(normal_cdf("z"), F.lit(0.0)))


def expected_max_sharpe(trials: int) -> float:
    """Expected largest of so many independent unit-variance Sharpe ratios; 0 for one."""
    if trials <= 1:
        return 0.0
    q = NormalDist().inv_cdf
    return (1 - EULER) * q(1 - 1 / trials) + EULER * q(1 - 1 / (trials * E_))


def expected_max(trials: str) -> Column:
    """expected_max_sharpe of a column of numbers of trials."""
    from pyspark.sql.types import DoubleType

    return F.pandas_udf(lambda n: n.map({k: expected_max_sharpe(int(k)) for k in n.unique()}).astype(float), DoubleType())(F.col(trials))


def deflated_sharpe(df: DataFrame, by: list[str], trials: int) -> DataFrame:
    """dsr: the probabilistic Sharpe ratio against the best of `trials` by luck alone."""
    n = df.groupBy(*by).agg(F.count("ret").alias("n"))
    bench = n.withColumn("__b", F.when(F.col("n") > 1, expected_max_sharpe(trials) * F.sqrt(F.lit(YEAR) / (F.col("n") - 1))).otherwise(0.0)).drop("n")
    z = psr_z(df, by)
    var = (1 + F.col("sr") ** 2 / 2 - F.col("skew") * F.col("sr") + F.col("kurt") / 4 * F.col("sr") ** 2) / (F.col("n") - 1)
    out = z.join(bench, by).withColumn("z", F.when(F.col("n") >= 5, (F.col("sr") - F.col("__b") / sqrt(YEAR)) / F.sqrt(F.greatest(var, F.lit(1e-12)))))
    return out.withColumn("dsr", F.coalesce(normal_cdf("z"), F.lit(0.0))).drop("__b")


def drawdown(df: DataFrame, anchored: bool = True) -> DataFrame:
    """(series_id, max_drawdown): positive share lost from a peak; anchored: the start value counts as a peak."""
    w = Window.partitionBy("series_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    n = df.where("ret is not null").withColumn("__nav", F.product(1 + F.col("ret")).over(w))
    top = F.max("__nav").over(w)
    n = n.withColumn("__d", 1 - F.col("__nav") / (F.greatest(top, F.lit(1.0)) if anchored else top))
    return n.groupBy("series_id").agg(F.max("__d").alias("max_drawdown"))


def growth(df: DataFrame) -> DataFrame:
    """(series_id, n, total, cagr, vol)."""
    g = df.groupBy("series_id").agg(F.count("ret").alias("n"), F.sum(F.log(1 + F.col("ret"))).alias("__l"), (F.stddev_samp("ret") * sqrt(YEAR)).alias("vol"))
    return g.select("series_id", "n", (F.exp("__l") - 1).alias("total"), (F.exp(F.col("__l") * YEAR / F.col("n")) - 1).alias("cagr"), "vol")


COMMISSION, HALF_SPREAD, SLIPPAGE = 2.0, 0.5, 3.0
ROUND_TRIP = 2 * (COMMISSION + HALF_SPREAD + SLIPPAGE)


def net_of_costs(df: DataFrame, turnover: DataFrame, stress: float = 1.0) -> DataFrame:
    """df with net: return less turnover at the round-trip cost in basis points; missing turnover is none."""
    t = turnover.select("series_id", "date", F.col("turnover").alias("__t"))
    return df.join(t, ["series_id", "date"], "left").withColumn("net", F.col("ret") - F.coalesce("__t", F.lit(0.0)) * (ROUND_TRIP * stress / 1e4)).drop("__t")


def simple_ols(df: DataFrame, by: list[str], y: str, x: str, at_least: int = 20) -> DataFrame:
    """by with n, alpha, beta, alpha_t, beta_t of y on x in one pass of grouped sums; NULL statistics below at_least rows or without spread.

    A fit that leaves no residual variance has t of 0: an exact copy has no skill of its own.
    """
    a = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.regr_sxx(F.col(y), F.col(x)).alias("sxx"), F.regr_syy(F.col(y), F.col(x)).alias("syy"), F.regr_sxy(F.col(y), F.col(x)).alias("sxy")
    )
    a = a.withColumn("beta", div("sxy", "sxx")).withColumn("alpha", F.col("my") - F.col("beta") * F.col("mx"))
    a = a.withColumn("s2", F.greatest(F.col("syy") - F.col("beta") * F.col("sxy"), F.lit(0.0)) / F.greatest(F.col("n") - 2, F.lit(1)))
    exact = F.col("s2") <= 1e-12 * F.col("syy") / F.col("n")
    t = lambda v, var: F.when(exact, 0.0).otherwise(F.col(v) / F.sqrt(var))
    a = a.withColumn("alpha_t", t("alpha", F.col("s2") * (1 / F.col("n") + F.col("mx") ** 2 / F.col("sxx")))).withColumn("beta_t", t("beta", F.col("s2") / F.col("sxx")))
    enough = F.col("n") >= at_least
    return a.select(*by, "n", "mx", "my", "sxx", "s2", *[F.when(enough, F.col(c)).alias(c) for c in ("alpha", "beta", "alpha_t", "beta_t")])


def benchmark_alpha(df: DataFrame, bench: DataFrame, at_least: int = 20) -> DataFrame:
    """(series_id, n, alpha (annual), alpha_t, alpha_p, beta, beta_t, ir, active, tracking) against bench (date, b)."""
    j = df.join(F.broadcast(bench) if "b" in bench.columns else bench, "date")
    fit = simple_ols(j, ["series_id"], "ret", "b", at_least)
    act = j.groupBy("series_id").agg((F.avg(F.col("ret") - F.col("b")) * YEAR).alias("active"), (F.stddev_samp(F.col("ret") - F.col("b")) * sqrt(YEAR)).alias("tracking"))
    resid = F.sqrt(F.col("s2") * (F.col("n") - 2) / (F.col("n") - 1))
    out = fit.join(act, "series_id").withColumn("ir", div("alpha", resid) * sqrt(YEAR)).withColumn("alpha_p", student_p("alpha_t", F.col("n") - 2))
    return out.select("series_id", "n", (F.col("alpha") * YEAR).alias("alpha"), "alpha_t", "alpha_p", "beta", "beta_t", "ir", "active", "tracking")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def student_tail(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t."""
    from math import exp, lgamma, log

    x = dof / (dof + t * t)
    if x >= 1:
        return 1.0
    a, b = dof / 2, 0.5
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_p(t: str | Column, dof: Column) -> Column:
    from pyspark.sql.types import DoubleType

    def run(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else student_tail(a, b) for a, b in zip(t, n, strict=True)], dtype=float)

    return F.pandas_udf(run, DoubleType())(col(t), dof.cast("double"))


def gram(df: DataFrame, by: list[str], y: str, xs: list[str]) -> DataFrame:
    """Sums of products of [1, xs, y]: the upper triangle as columns g_i_j, added up map-side."""
    full = df.dropna(subset=[y, *xs]).select(*by, F.lit(1.0).alias("__v0"), *[F.col(x).alias(f"__v{k + 1}") for k, x in enumerate([*xs, y])])
    m = len(xs) + 2
    return full.groupBy(*by).agg(*[F.sum(F.col(f"__v{i}") * F.col(f"__v{j}")).alias(f"g_{i}_{j}") for i in range(m) for j in range(i, m)])


def multi_ols(df: DataFrame, by: list[str], y: str, xs: list[str]) -> DataFrame:
    """by with n, coefs and tstats (intercept first) from the grouped Gram matrix: the rows themselves are read once and never gathered."""
    m = len(xs) + 2

    def solve(batches):
        for b in batches:
            out = []
            for _, r in b.iterrows():
                g = np.zeros((m, m))
                for i in range(m):
                    for j in range(i, m):
                        g[i, j] = g[j, i] = r[f"g_{i}_{j}"]
                xx, xy, yy, n = g[:-1, :-1], g[:-1, -1], g[-1, -1], g[0, 0]
                inv = np.linalg.pinv(xx)
                beta = inv @ xy
                s2 = max(yy - beta @ xy, 0.0) / max(n - len(beta), 1)
                exact = s2 <= 1e-12 * max(yy / n - (g[0, -1] / n) ** 2, 0)
                t = np.zeros(len(beta)) if exact else beta / np.sqrt(np.maximum(s2 * np.diag(inv), 1e-300))
                out.append((*[r[k] for k in by], int(n), beta.tolist(), t.tolist()))
            yield pd.DataFrame(out, columns=[*by, "n", "coefs", "tstats"])

    g = gram(df, by, y, xs)
    kinds = dict(df.dtypes)
    return g.mapInPandas(solve, ", ".join(f"`{k}` {kinds[k]}" for k in by) + ", n long, coefs array<double>, tstats array<double>")


def factor_alpha(df: DataFrame, factors: DataFrame, names: list[str], at_least: int = 30) -> DataFrame:
    """(series_id, n, alpha (annual), alpha_t, betas): excess returns on factors of the same day and the day before; betas add both."""
    w = Window.orderBy("date")  # one row a market day
    lagged = factors.select("*", *[F.lag(f).over(w).alias(f"{f}_lag") for f in names]).dropna(subset=[f"{f}_lag" for f in names])
    xs = [*names, *[f"{f}_lag" for f in names]]
    j = df.join(F.broadcast(lagged), "date").withColumn("__y", F.col("ret") - F.col("rf"))
    fit = multi_ols(j, ["series_id"], "__y", xs).where(F.col("n") >= at_least)
    k = len(names)
    betas = F.array(*[F.col("coefs")[i + 1] + F.col("coefs")[i + 1 + k] for i in range(k)])
    return fit.select("series_id", "n", (F.col("coefs")[0] * YEAR).alias("alpha"), F.col("tstats")[0].alias("alpha_t"), betas.alias("betas"))


def residual_returns(df: DataFrame, factors: DataFrame, names: list[str], bench: DataFrame, factor_rows: int = 60, bench_rows: int = 20) -> DataFrame:
    """(series_id, date, method, residual): returns without their exposures, the intercept left in.

    A series that the factors (date, names, rf) cover on `factor_rows` days is taken over rf without its factor
    exposures, on those days; one that the benchmark (date, b) covers on `bench_rows` days without its beta, on those;
    any other as it is. Both fits come from one pass of sums, each over the rows where its regressors are known.
    """
    known = factors.select("date", *[F.col(f).alias(f"__f{k}") for k, f in enumerate(names)], F.col("rf").alias("__rf")).dropna()
    j = df.where("ret is not null").join(known, "date", "left").join(bench.select("date", F.col("b").alias("__b")), "date", "left")
    j = j.withColumns({"__has": F.col("__rf").isNotNull(), "__y": F.col("ret") - F.col("__rf")})
    v = [F.lit(1.0), *[F.col(f"__f{k}") for k in range(len(names))], F.col("__y")]
    m = len(v)
    both = F.when(F.col("__b").isNotNull(), F.col("ret"))
    sums = j.groupBy("series_id").agg(
        *[F.sum(F.when(F.col("__has"), v[i] * v[k])).alias(f"g_{i}_{k}") for i in range(m) for k in range(i, m)],
        F.count_if("__has").alias("nf"), F.count("__b").alias("nb"), div(F.regr_sxy(both, F.col("__b")), F.regr_sxx(both, F.col("__b"))).alias("beta"),
    )

    def solve(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                g = np.array([[getattr(r, f"g_{min(i, k)}_{max(i, k)}") for k in range(m)] for i in range(m)], float)
                out.append((np.linalg.pinv(g[:-1, :-1]) @ g[:-1, -1])[1:] if r.nf >= factor_rows else None)
            yield batch[["series_id", "nf", "nb", "beta"]].assign(betas=out)

    fits = sums.mapInPandas(solve, f"series_id {dict(df.dtypes)['series_id']}, nf long, nb long, beta double, betas array<double>")
    method = F.when(F.col("nf") >= factor_rows, "factors").when((F.col("nb") >= bench_rows) & F.col("beta").isNotNull(), "benchmark").otherwise("raw")
    j = j.join(fits.withColumn("method", method).withColumnRenamed("series_id", "__s"), F.col("series_id") == F.col("__s"))
    exposure = sum((F.get("betas", F.lit(k)) * F.col(f"__f{k}") for k in range(len(names))), F.lit(0.0))
    value = F.when(F.col("method") == "factors", F.when(F.col("__has"), F.col("__y") - exposure)).when(F.col("method") == "benchmark", F.col("ret") - F.col("beta") * F.col("__b")).otherwise(F.col("ret"))
    return j.select("series_id", "date", "method", value.alias("residual")).where("residual is not null")


def marginal_sharpe(df: DataFrame, book: DataFrame, at_least: int = 10) -> DataFrame:
    """(series_id, marginal_sharpe) of what a no-intercept fit on the book leaves; the own Sharpe ratio where they overlap in fewer rows."""
    j = df.join(F.broadcast(book), "date")
    beta = j.groupBy("series_id").agg(div(F.sum(F.col("ret") * F.col("b")), F.sum(F.col("b") * F.col("b"))).alias("beta"), F.count(F.lit(1)).alias("n"))
    rest = j.join(beta, "series_id").withColumn("e", F.col("ret") - F.coalesce("beta", F.lit(0.0)) * F.col("b"))
    m = rest.groupBy("series_id").agg(sharpe("e").alias("m"), F.first("n").alias("n"))
    own = df.groupBy("series_id").agg(sharpe().alias("own"))
    return own.join(m, "series_id", "left").select("series_id", F.when(F.col("n") >= at_least, F.col("m")).otherwise(F.col("own")).alias("marginal_sharpe"))


def blend(book: DataFrame, new: DataFrame, weight: float) -> DataFrame:
    """(date, ret) of (1 - weight) * book + weight * new on their common days."""
    return book.join(new, "date").select("date", ((1 - weight) * F.col("b") + weight * F.col("ret")).alias("ret"))


def min_alpha_t(active: int) -> float:
    return max(0.5, 2 - 0.01 * active)


def leave_one_out(df: DataFrame) -> DataFrame:
    """df with others: the mean of all other series that day, from one sum a day."""
    w = Window.partitionBy("date")
    return df.withColumn("others", div(F.sum("ret").over(w) - F.col("ret"), F.count("ret").over(w) - 1))


def backward_elimination(df: DataFrame, at_least: int = 30, adaptive: bool = False) -> DataFrame:
    """(series_id, step, n, alpha_t): the series with the least alpha_t against the mean of the others goes while it is below the gate.

    step is the round a series went in, NULL if it stays; n and alpha_t are of that round or of the last one. The gate is
    min_alpha_t of all series, or with `adaptive` of those left. A series without alpha_t (fewer than `at_least` common
    days, no spread, an exact fit) stays; so does the last one. Repeated days of a series are averaged.

    Days with the same series are one block, whose rows ([1, returns]) are replaced by their triangular factor: it has
    at most one row more than columns and the same sums of products, which is all that the fits need. The rounds then run
    in one task over these factors, which grow with the number of series and of their patterns of missing days.
    """
    daily = df.where("ret is not null").groupBy("date", "series_id").agg(F.avg("ret").alias("ret"))
    days = daily.groupBy("date").agg(F.sort_array(F.collect_list(F.struct("series_id", "ret"))).alias("s")).select(F.year("date").alias("year"), F.col("s.series_id").alias("ids"), F.col("s.ret").alias("rets"))
    kind = f"array<{dict(df.dtypes)['series_id']}>"

    def factor(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(np.column_stack([np.ones(len(rows)), np.stack(rows["rets"])]), mode="r")
        return pd.DataFrame({"ids": [list(key[0])] * len(r), "row": list(r)})

    def rounds(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted({x for ids in rows["ids"] for x in ids})
        at = {x: k for k, x in enumerate(names)}
        one, held = np.zeros(len(rows)), np.zeros((len(rows), len(names)), bool)
        value = np.zeros((len(rows), len(names)))
        for k, (ids, row) in enumerate(zip(rows["ids"], rows["row"], strict=True)):
            cols = [at[x] for x in ids]
            one[k], held[k, cols], value[k, cols] = row[0], True, row[1:]
        kept, step, out = np.ones(len(names), bool), 0, {}
        while True:
            step += 1
            k = held[:, kept].sum(1)
            total = value[:, kept].sum(1)
            both = held & (k > 1)[:, None] & kept
            y = np.where(both, value, 0)
            x = np.where(both, (total[:, None] - value) / np.maximum(k - 1, 1)[:, None], 0)
            o = np.where(both, one[:, None], 0)
            n = (o * o).sum(0)
            safe = np.maximum(n, 1)
            mx, my = (o * x).sum(0) / safe, (o * y).sum(0) / safe
            dx, dy = x - o * mx, y - o * my
            sxx, sxy, syy = (dx * dx).sum(0), (dx * dy).sum(0), (dy * dy).sum(0)
            beta = sxy / np.where(sxx > 0, sxx, 1)
            rest = dy - beta * dx
            s2 = (rest * rest).sum(0) / np.maximum(n - 2, 1)
            known = kept & (np.rint(n) >= at_least) & (sxx > 1e-24 * safe) & (s2 > 1e-12 * syy / safe)
            t = np.where(known, (my - beta * mx) / np.sqrt(np.where(known, s2 * (1 / safe + mx * mx / np.where(sxx > 0, sxx, 1)), 1)), np.inf)
            worst = int(t.argmin())
            now = {names[c]: (int(round(n[c])), float(t[c]) if known[c] else None) for c in np.flatnonzero(kept)}
            if kept.sum() < 2 or not t[worst] < min_alpha_t(int(kept.sum()) if adaptive else len(names)):
                out |= {x: (x, None, *v) for x, v in now.items()}
                return pd.DataFrame(list(out.values()), columns=["series_id", "step", "n", "alpha_t"]).astype({"step": "Int32", "alpha_t": "Float64"})
            out[names[worst]] = (names[worst], step, *now[names[worst]])
            kept[worst] = False

    factors = days.groupBy("ids", "year").applyInPandas(factor, f"ids {kind}, row array<double>")
    return factors.groupBy().applyInPandas(rounds, f"series_id {dict(df.dtypes)['series_id']}, step int, n long, alpha_t double")


SORTED = 100_000  # values that one task may sort


def order_values(df: DataFrame, x: str, shares: list[float], sorted_rows: int = SORTED) -> tuple[list[float | None], int]:
    """Values of x at the places share * (n - 1), linear between neighbours as `percentile` has them, and n; NULL is no value.

    Ranks are selected by counts of ranges: estimated quantiles bracket each rank, exact counts tell which side of the
    bracket holds it, and only that range is looked at again, until `sorted_rows` values or equal ones are left. No
    task holds the distinct values of the column, and a wrong estimate costs a round, not the result.
    """
    values = df.select(F.col(x).cast("double").alias("v")).where("v is not null")
    n, least, most = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(shares), 0
    if n > sorted_rows:
        values = stored(values, "values")
    places = [share * (n - 1) for share in shares]
    ranks = sorted({k for p in places for k in (int(p), min(int(p) + 1, n - 1))})
    open_ = {r: (least, most, 0, n) for r in ranks}  # rank -> range (ends included), rows below it, rows in it
    found: dict[int, float] = {}
    inside = lambda lo, hi: F.col("v").between(lo, hi)
    while True:
        found |= {r: lo for r, (lo, hi, _, _) in open_.items() if lo == hi}
        open_ = {r: o for r, o in open_.items() if r not in found}
        wide = {r: o for r, o in open_.items() if o[3] > sorted_rows}
        if not wide:
            break
        ask = lambda r, o, d: F.percentile_approx(F.when(inside(o[0], o[1]), F.col("v")), F.array(*[F.lit(min(1.0, max(0.0, (r - o[2] + s) / o[3]))) for s in (-d, d)]), 10_000)
        near = values.agg(*[ask(r, o, 2e-4 * o[3] + 1) for r, o in wide.items()]).first()
        cuts = {r: ((a, b) if (a, b) != (o[0], o[1]) else (b, b) if r - o[2] > o[3] / 2 else (a, a)) for (r, o), (a, b) in zip(wide.items(), near, strict=True)}
        counts = values.agg(*[f for r, (lo, hi, _, _) in wide.items() for a, b in [cuts[r]] for f in (
            F.count(F.when((F.col("v") >= lo) & (F.col("v") < a), 1)), F.count(F.when(inside(a, b), 1)), F.max(F.when(F.col("v") < a, F.col("v"))), F.min(F.when(F.col("v") > b, F.col("v"))))]).first()
        for k, (r, (lo, hi, below, size)) in enumerate(wide.items()):
            (left, mid, under, over), (a, b) = counts[4 * k : 4 * k + 4], cuts[r]
            if r - below < left:
                open_[r] = (lo, under, below, left)
            elif r - below < left + mid:
                open_[r] = (a, b, below + left, mid)
            else:
                open_[r] = (over, hi, below + left + mid, size - left - mid)
    if open_:
        ranges = sorted({o for o in open_.values()})
        held = values.agg(*[F.sort_array(F.collect_list(F.when(inside(lo, hi), F.col("v")))).alias(f"r{k}") for k, (lo, hi, _, _) in enumerate(ranges)])
        rows = held.select(*[F.get(f"r{ranges.index(o)}", F.lit(r - o[2])) for r, o in open_.items()]).first()
        found |= dict(zip(open_, rows, strict=True))
    out = []
    for p in places:
        a, b = found[int(p)], found[min(int(p) + 1, n - 1)]
        out.append(a if p == int(p) else a + (p - int(p)) * (b - a))
    return out, n


def group_quantiles(df: DataFrame, by: str, x: str, shares: list[float], block_rows: int = SORTED) -> DataFrame:
    """(by, n, most, values): of each group the number of values, the largest, and those at places share * (n - 1), linear between neighbours.

    Values are dealt to blocks by range of (group, value), blocks are counted, and only those that hold an asked rank
    are sorted, so a group of any size lies over many tasks. NULL is no value; a NULL group is left out.
    """
    rows = df.select(F.col(by).alias("g"), F.col(x).alias("v")).where("g is not null and v is not null").withColumn("rid", F.monotonically_increasing_id())
    parts = max(1, -(-rows.count() // block_rows))
    blocks = stored(rows.repartitionByRange(parts, "g", "v", "rid").select("g", "v", F.spark_partition_id().alias("b")), "value-blocks")
    before, whole = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("g")
    counts = blocks.groupBy("g", "b").agg(F.count(F.lit(1)).alias("c"), F.max("v").alias("top"))
    counts = stored(counts.withColumns({"p0": F.coalesce(F.sum("c").over(before), F.lit(0)), "n": F.sum("c").over(whole), "most": F.max("top").over(whole)}), "block-counts")
    ranks = F.flatten(F.transform(F.array(*[F.lit(float(q)) for q in shares]), lambda q: F.array(F.floor(q * (F.col("n") - 1)), F.ceil(q * (F.col("n") - 1)))))
    asked = counts.select("g", "b", "p0", "c", F.explode(F.array_distinct(ranks)).alias("rank")).where("p0 <= rank and rank < p0 + c").select("g", "b", "rank", (F.col("rank") - F.col("p0") + 1).alias("k"))
    held = blocks.join(asked.select("g", "b").distinct(), ["g", "b"], "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("g", "b").orderBy("v")))
    found = held.join(asked, ["g", "b", "k"]).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    sizes = counts.select(F.col("g").alias("g2"), "n", "most").distinct()
    out = sizes.join(found, F.col("g") == F.col("g2"))

    def value(q: float) -> Column:
        p = F.lit(float(q)) * (F.col("n") - 1)
        a, b = F.element_at("at", F.floor(p)), F.element_at("at", F.ceil(p))
        return a + (p - F.floor(p)) * (b - a)

    return out.select(F.col("g").alias(by), "n", "most", F.array(*[value(q) for q in shares]).alias("values"))


def winsorize(df: DataFrame, x: str, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """x cut at its overall quantiles."""
    (a, b), n = order_values(df, x, [lo, hi])
    return df.withColumn(x, F.when(F.col(x).isNotNull(), F.least(F.greatest(x, F.lit(a)), F.lit(b)))) if n else df


def mean_t(x: str) -> Column:
    return div(F.avg(x), F.stddev_samp(x) / F.sqrt(F.count(x)))


def welch_t(df: DataFrame, x: str, flag: Column) -> DataFrame:
    """One row: t of the difference of means of two groups with unlike variances."""
    a, b = F.when(flag, F.col(x)), F.when(~flag, F.col(x))
    return df.agg(div(F.avg(a) - F.avg(b), F.sqrt(F.var_samp(a) / F.count(a) + F.var_samp(b) / F.count(b))).alias("t"))


def cluster_ols(df: DataFrame, y: str, xs: list[str], cluster: str, at_least: int = 50) -> dict | None:
    """OLS with cluster-robust errors: coefficients, t-statistics, n, number of clusters; None below at_least rows.

    Two grouped passes: the Gram matrix, then the score sums of each cluster, whose outer products are added up in Spark.
    """
    full = df.dropna(subset=[y, *xs])
    g = gram(full.withColumn("__all", F.lit(1)), ["__all"], y, xs).first()
    m = len(xs) + 2
    if g is None or g["g_0_0"] < at_least:
        return None
    gm = np.array([[g[f"g_{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)])
    inv = np.linalg.pinv(gm[:-1, :-1])
    beta = inv @ gm[:-1, -1]
    v = [F.lit(1.0), *[F.col(x) for x in xs]]
    e = F.col(y) - sum((F.lit(float(b)) * x for b, x in zip(beta, v, strict=True)), F.lit(0.0))
    s = full.withColumn("__e", e).groupBy(cluster).agg(*[F.sum(x * F.col("__e")).alias(f"s{k}") for k, x in enumerate(v)])
    k = len(v)
    meat = s.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m_{i}_{j}") for i in range(k) for j in range(i, k)], F.count(F.lit(1)).alias("groups")).first()
    mm = np.array([[meat[f"m_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    n, groups = gm[0, 0], meat["groups"]
    cov = inv @ mm @ inv * (groups / (groups - 1)) * ((n - 1) / (n - k))
    return {"coefs": beta.tolist(), "tstats": (beta / np.sqrt(np.diag(cov))).tolist(), "n": int(n), "clusters": int(groups)}


# fixed values: MacKinnon's (1994) approximation of the Dickey-Fuller distribution with a constant
_ADF_STAR, _ADF_MIN, _ADF_MAX = -1.61, -18.83, 2.74
_ADF_SMALL = (2.1659, 1.4412, 0.038269)
_ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def _dickey_fuller_p(t: float) -> float:
    if not np.isfinite(t) or t > _ADF_MAX:
        return 1.0
    if t < _ADF_MIN:
        return 0.0
    coef = _ADF_SMALL if t <= _ADF_STAR else _ADF_LARGE
    return NormalDist().cdf(sum(c * t**k for k, c in enumerate(coef)))


def _unit_root(n: int, lags: int, count: int, sx: float, sxx: float, moments: dict[int, tuple[float, float, float]], edges: dict[int, float]) -> tuple[int, float, float]:
    """Chosen lags, t and p of one series from its sums.

    moments: by lag j the sums of d[s - j], x[s] * d[s - j] and d[s] * d[s - j] over s from `lags` on, for the changes
    d[s] = x[s + 1] - x[s]. Products of two lags follow from them, as a sum shifted by one differs at its ends only.
    """
    d = lambda s: edges[s + 1] - edges[s]
    size, last = lags + 3, n - 2
    sd, xd, dd = ([moments[j][k] for j in range(lags + 1)] for k in range(3))
    c = np.zeros((lags + 1, lags + 1))
    c[0] = dd
    for i in range(1, lags + 1):
        for j in range(i, lags + 1):
            c[i, j] = c[i - 1, j - 1] + d(lags - i) * d(lags - j) - d(last - i + 1) * d(last - j + 1)
    c = np.triu(c) + np.triu(c, 1).T
    g = np.zeros((size, size))  # constant, x, lagged changes, change
    order = [*range(1, lags + 1), 0]
    g[0, 0], g[0, 1], g[1, 1] = count, sx, sxx
    g[0, 2:], g[1, 2:] = [sd[j] for j in order], [xd[j] for j in order]
    g[2:, 2:] = c[np.ix_(order, order)]
    g = np.triu(g) + np.triu(g, 1).T
    scale = 1 / np.sqrt(np.maximum(np.diag(g), 1e-300))
    try:  # the squares left by the first regressors, one more at a time, are read off one factor
        y = np.linalg.cholesky(g * scale * scale[:, None])[-1]
        rest = [max((1 - (y[: 2 + k] ** 2).sum()), 1e-300) / scale[-1] ** 2 for k in range(lags + 1)]
    except np.linalg.LinAlgError:
        rest = [max(g[-1, -1] - g[-1, : 2 + k] @ np.linalg.pinv(g[: 2 + k, : 2 + k]) @ g[-1, : 2 + k], 1e-300) for k in range(lags + 1)]
    best = int(np.argmin([count * (np.log(2 * np.pi * r / count) + 1) + 2 * (k + 2) for k, r in enumerate(rest)]))
    keep = [*range(best + 2), size - 1]
    g = g[np.ix_(keep, keep)]
    for s in range(best, lags):  # with fewer lags the sample begins earlier
        row = np.array([1.0, edges[s], *[d(s - j) for j in range(1, best + 1)], d(s)])
        g += np.outer(row, row)
    scale = 1 / np.sqrt(np.maximum(np.diag(g)[:-1], 1e-300))
    inv = np.linalg.pinv(g[:-1, :-1] * scale * scale[:, None]) * scale * scale[:, None]
    beta = inv @ g[:-1, -1]
    left = max(g[-1, -1] - beta @ g[:-1, -1], 0.0) / max(g[0, 0] - len(beta), 1)
    t = beta[1] / np.sqrt(left * inv[1, 1]) if left * inv[1, 1] > 0 else np.nan
    return best, float(t), _dickey_fuller_p(t)


def unit_roots(df: DataFrame, by: list[str], order: str, x: str) -> DataFrame:
    """by with n, lags, t, p: augmented Dickey-Fuller test with a constant, lags by the least AIC; p is 1 where it can't be computed.

    A table of cross moments by lag is summed map-side; all orders of lags are then solved from these sums, so rows are
    read once whatever the orders and no series is gathered. Values that are NULL or not finite are left out.
    """
    w, whole = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by)
    v = F.col(x).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).select(*by, order, v.alias("v"))
    longest = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    lags_of = lambda n: F.least(F.ceil(12 * F.pow(n / 100, F.lit(0.25))), F.floor(n / 2) - 2).cast("int")
    most = max(0, min(int(np.ceil(12 * (longest / 100) ** 0.25)), longest // 2 - 2))
    rows = rows.select(*by, order, (F.col("v") - F.first("v").over(w)).alias("v"), (F.row_number().over(w) - 1).alias("__k"), F.count(F.lit(1)).over(whole).alias("n"))
    rows = rows.withColumns({"before": F.lag("v").over(w), "d": F.col("v") - F.lag("v").over(w), "lags": F.greatest(lags_of(F.col("n")), F.lit(0))})
    rows = rows.withColumn("near", F.reverse(F.collect_list("d").over(w.rowsBetween(-most, 0))))
    inside = F.col("__k") > F.col("lags")
    edge = (F.col("__k") <= F.col("lags") + 1) | (F.col("__k") >= F.col("n") - F.col("lags") - 2)
    sums = rows.groupBy(*by).agg(
        F.first("n").alias("n"), F.first("lags").alias("lags"), F.count_if(inside).alias("count"), F.sum(F.when(inside, F.col("before"))).alias("sx"),
        F.sum(F.when(inside, F.col("before") * F.col("before"))).alias("sxx"), (F.max("v") - F.min("v")).alias("span"), F.collect_list(F.when(edge, F.struct(F.col("__k").alias("k"), "v"))).alias("edges"),
    )
    lagged = rows.where(inside).select(*by, F.col("before").alias("x"), F.get("near", F.lit(0)).alias("d"), F.posexplode(F.slice("near", F.lit(1), F.col("lags") + 1)).alias("j", "dj"))
    moments = lagged.groupBy(*by, "j").agg(F.sum("dj").alias("sd"), F.sum(F.col("x") * F.col("dj")).alias("xd"), F.sum(F.col("d") * F.col("dj")).alias("dd"))
    moments = moments.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.collect_list(F.struct("j", "sd", "xd", "dd")).alias("moments"))
    joined = sums.join(moments, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], "left")

    def solve(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.n < 20 or r.span == 0:
                    out.append((0, None, 1.0))
                    continue
                known = {m["j"]: (m["sd"], m["xd"], m["dd"]) for m in r.moments}
                out.append(_unit_root(int(r.n), int(r.lags), int(r.count_), r.sx, r.sxx, known, {e["k"]: e["v"] for e in r.edges}))
            yield batch[[*by, "n"]].assign(lags=[x for x, _, _ in out], t=[y for _, y, _ in out], p=[z for _, _, z in out])

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", n long, lags int, t double, p double"
    return joined.select(*by, "n", "lags", F.col("count").alias("count_"), "sx", "sxx", "span", "edges", "moments").mapInPandas(solve, schema)


def kelly(df: DataFrame, n: int = 63, at_least: int = 20) -> DataFrame:
    """(series_id, leverage): mean / variance of the last n returns within [0, 2]; 1 with too few or no spread."""
    k = F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("date").desc()))
    t = df.where("ret is not null").withColumn("__k", k).where(F.col("__k") <= n).groupBy("series_id").agg(F.count("ret").alias("c"), div(F.avg("ret"), F.var_samp("ret")).alias("f"))
    return t.select("series_id", F.when((F.col("c") < at_least) | F.col("f").isNull(), 1.0).otherwise(F.least(F.greatest("f", F.lit(0.0)), F.lit(2.0))).alias("leverage"))
