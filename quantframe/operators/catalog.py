"""Research catalog: hypotheses, trial returns, signal library. Tables are DataFrames; a change is a new table, committed as the next version (sources.manifest)."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import col, div

# fixed values: phrases that reason from a fit, cohorts, names and sizes that an expression must not have
FITTED_PHRASES = (
    "backtested well",
    "historically correlated",
    "showed a pattern",
    "pattern in the data",
    "historical pattern",
    "machine learning found",
    "data showed",
    "empirically observed",
    "in the past",
    "has worked",
    "tends to",
)
COHORTS = ("momentum", "value", "quality", "macro")
BANNED_NAMES = ("open", "exec", "eval", "compile", "__import__", "importlib", "subprocess", "os", "sys", "socket", "requests", "urllib", "http", "builtins")
MAX_CHARS, MIN_WORDS = 4000, 20
FLOOR, CEILING, TARGET, WINDOW, DECAY, DEATH = 0.3, 2.5, 0.5, 63, 63, 126


def knowledge_faults(text: str | Column, cohort: str | Column) -> Column:
    """Faults of a hypothesis: too few words, a phrase that reasons from a fit, an unknown cohort; an empty array is valid."""
    t = F.coalesce(col(text), F.lit(""))
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    fitted = F.lower(t).rlike("|".join(FITTED_PHRASES))
    rules = [(words < MIN_WORDS, "short"), (fitted, "fitted"), (~F.coalesce(col(cohort).isin(*COHORTS), F.lit(False)), "cohort")]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))


def upsert(table: DataFrame, new: DataFrame, key: list[str], replace: bool = True) -> DataFrame:
    """table with new rows by key: replaced, or ignored where the key is there."""
    base, extra = (table.join(new, key, "left_anti"), new) if replace else (table, new.join(table, key, "left_anti"))
    return base.unionByName(extra.select(*table.columns))


def next_trial(hypotheses: DataFrame) -> DataFrame:
    return hypotheses.agg((F.coalesce(F.max("trial_number"), F.lit(0)) + 1).cast("long").alias("next"))


def pack_series(returns: DataFrame, key: str) -> DataFrame:
    """One row per series: n_bars, first and last date, and the ordered array; NULL returns are left out."""
    s = F.array_sort(F.collect_list(F.struct("date", "ret")))
    return returns.where("ret is not null").groupBy(key).agg(F.count("ret").alias("n_bars"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), s.alias("series"))


def unpack_series(stored: DataFrame, key: str) -> DataFrame:
    return stored.select(key, F.explode("series").alias("s")).select(key, "s.date", "s.ret")


def sync_active(library: DataFrame, active: DataFrame) -> DataFrame:
    """Library (name, status, weight) with new active names at weight 1 and names no longer active dead."""
    joined = library.join(active.select(F.col("name").alias("n2")), F.col("name") == F.col("n2"), "full_outer")
    return joined.select(F.coalesce("name", "n2").alias("name"), F.when(F.col("n2").isNull(), "dead").when(F.col("name").isNull(), "active").otherwise(F.col("status")).alias("status"), F.coalesce("weight", F.lit(1.0)).alias("weight"))


def update_weights(library: DataFrame, returns: DataFrame, as_of: str, at_least: int = 10) -> DataFrame:
    """(name, weight, sharpe, days_at_floor, status): weight = Sharpe over the last 63 business days / target, within floor and ceiling; names at the floor count days and decay, then die."""
    from .labels import business_day

    start = business_day("__asof", -WINDOW)
    r = returns.withColumn("__asof", F.lit(as_of).cast("date")).where((F.col("date") <= F.col("__asof")) & (F.col("date") >= start))
    s = r.groupBy(F.col("series_id").alias("n2")).agg(F.count("ret").alias("c"), (F.coalesce(div(F.avg("ret"), F.stddev_samp("ret")), F.lit(0.0)) * sqrt(252)).alias("sharpe"))
    j = library.join(s.where(F.col("c") >= at_least), F.col("name") == F.col("n2"), "left")
    w = F.when(F.col("sharpe").isNotNull(), F.least(F.greatest(F.col("sharpe") / TARGET, F.lit(FLOOR)), F.lit(CEILING))).otherwise(F.col("weight"))
    j = j.withColumn("w", w).withColumn("days", F.when(F.col("sharpe").isNull(), F.col("days_at_floor")).when(F.col("w") <= FLOOR, F.col("days_at_floor") + 1).otherwise(0))
    status = F.when(F.col("days") >= DEATH, "dead").when(F.col("days") >= DECAY, "decayed").when(F.col("status") == "dead", "dead").otherwise("active")
    return j.select("name", F.col("w").alias("weight"), "sharpe", F.col("days").cast("long").alias("days_at_floor"), status.alias("status"))


def floor_streak(history: DataFrame) -> DataFrame:
    """(name, streak): rows at the floor at the end of each name's history (gaps and islands)."""
    up = F.max(F.when(F.col("weight") > FLOOR, F.col("date"))).over(Window.partitionBy("name"))
    return history.withColumn("up", up).groupBy("name").agg(F.count_if(F.col("up").isNull() | (F.col("date") > F.col("up"))).alias("streak"))


def checked_expression(spark: SparkSession, text: str, columns: list[str]) -> Column:
    """A score given as text: a Spark SQL expression over known columns, parsed by Spark and never executed as Python.

    The limits of length and names hold; an expression that Spark can't resolve over the columns is refused.
    """
    import re

    if len(text) > MAX_CHARS:
        raise ValueError("expression too long")
    names = set(re.findall(r"[A-Za-z_]\w*", text))
    if bad := sorted(names & set(BANNED_NAMES) - set(columns)):
        raise ValueError(f"names not allowed: {bad}")
    if re.search(r"(?i)\b(select|java_method|reflect|java_udf)\b", text):
        raise ValueError("only expressions over columns")
    probe = spark.createDataFrame([], ", ".join(f"`{c}` double" for c in columns))
    e = F.expr(text)
    probe.select(e.alias("x")).schema  # noqa: B018  resolves, and raises where it can't
    return e


def extract_json(text: str | Column) -> Column:
    """First {...} block of model output with code fences taken off, NULL where there is none."""
    bare = F.regexp_replace(col(text), r"```(?:json)?", "")
    found = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)
