"""Outcome labels and purged combinatorial cross-validation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import atr


def triple_barrier(bars: DataFrame, events: DataFrame, up: float = 2.0, down: float = 1.0, hold: int = 20, atr_days: int = 21) -> DataFrame:
    """(ticker, t0, t1, label, ret) of events (ticker, t0, optional entry): the first close of `hold` bars ahead that touches entry + up * atr (1) or entry - down * atr (-1), else the last (0).

    The look ahead is a bounded frame of each ticker's own rows. Events without a bar, without atr or without a bar ahead are left out.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    a = atr(bars, atr_days).withColumn("ahead", F.collect_list(F.struct("date", "close")).over(w.rowsBetween(1, hold))).where("atr > 0 and size(ahead) > 0")
    if "entry" not in events.columns:
        events = events.withColumn("entry", F.lit(None).cast("double"))
    j = events.join(a.select("ticker", F.col("date").alias("t0"), "close", "atr", "ahead"), ["ticker", "t0"])
    j = j.withColumn("px", F.coalesce("entry", "close")).withColumn("top", F.col("px") + up * F.col("atr")).withColumn("floor", F.col("px") - down * F.col("atr"))
    touch = F.filter("ahead", lambda x: (x["close"] >= F.col("top")) | (x["close"] <= F.col("floor")))
    j = j.withColumn("hit", F.try_element_at(touch, F.lit(1))).withColumn("out", F.coalesce("hit", F.element_at("ahead", -1)))
    label = F.when(F.col("hit").isNull(), 0).when(F.col("hit.close") >= F.col("top"), 1).otherwise(-1)
    return j.select("ticker", "t0", F.col("out.date").alias("t1"), label.alias("label"), (F.col("out.close") / F.col("px") - 1).alias("ret"))


def meta_labels(primary: DataFrame, outcome: DataFrame) -> DataFrame:
    """(ticker, t0, y): whether the primary side had the sign of the outcome."""
    return primary.join(outcome, ["ticker", "t0"]).withColumn("y", (F.signum("side") == F.signum("label")).cast("int"))


def fit_meta(rows: DataFrame, features: list[str], seed: int = 42, at_least: int = 10):
    """Scaler and forest that score how likely the primary side is right; None below at_least rows, a constant where there is one class."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    n, ones = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    if n < at_least:
        return None
    if ones in (0, n):
        return float(ones > 0)
    stages = [VectorAssembler(inputCols=features, outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="__x", withMean=True), RandomForestClassifier(featuresCol="__x", labelCol="y", numTrees=50, maxDepth=4, minInstancesPerNode=5, seed=seed)]
    return Pipeline(stages=stages).fit(rows)


def meta_probability(model, rows: DataFrame) -> DataFrame:
    """rows with proba; an unfitted model trusts the primary side (1)."""
    from pyspark.ml.functions import vector_to_array

    if model is None or isinstance(model, float):
        return rows.withColumn("proba", F.lit(1.0 if model is None else model))
    return model.transform(rows).withColumn("proba", vector_to_array("probability")[1]).drop("__raw", "__x", "rawPrediction", "probability", "prediction")


def business_day(date: str, n: int):
    """date moved by n business days (no holidays): back from the Monday after a weekend, forward from the Friday before it.

    Closed form: whole weeks, then the rest of a week with a weekend skipped where it is crossed.
    """
    d = F.col(date)
    wd = F.weekday(d)  # Monday 0
    if n < 0:
        base = F.when(wd >= 5, F.date_add(d, F.lit(7) - wd)).otherwise(d)
        weeks, rest = divmod(-n, 5)
        skip = F.when(F.weekday(base) < rest, 2).otherwise(0)
        return F.date_sub(base, F.lit(7 * weeks + rest) + skip)
    base = F.when(wd >= 5, F.date_sub(d, wd - 4)).otherwise(d)
    weeks, rest = divmod(n, 5)
    skip = F.when(F.weekday(base) + rest > 4, 2).otherwise(0)
    return F.date_add(base, F.lit(7 * weeks + rest) + skip)


def cpcv(dates: DataFrame, groups: int = 6, test: int = 2, purge: int = 20, embargo: int = 5) -> DataFrame:
    """(split, date, role): every choice of `test` of `groups` equal runs of days as test; training days leave out `purge` business days before and `embargo` after each test run.

    Days are a few thousand a decade and a choice is a literal, so a split is a filter, not a loop.
    """
    if not 0 < test < groups:
        raise ValueError("test groups must be fewer than groups")
    days = dates.select("date").distinct()
    n = days.count()
    if n < groups:
        raise ValueError("fewer days than groups")
    rn = F.row_number().over(Window.orderBy("date")) - 1
    days = days.withColumn("g", F.least(F.floor(rn / (n // groups)), F.lit(groups - 1)).cast("int"))
    spans = days.groupBy("g").agg(F.min("date").alias("a"), F.max("date").alias("b")).withColumn("lo", business_day("a", -purge)).withColumn("hi", business_day("b", embargo))
    splits = dates.sparkSession.createDataFrame([(k, list(c)) for k, c in enumerate(combinations(range(groups), test))], "split int, tests array<int>")
    every = days.crossJoin(F.broadcast(splits)).withColumn("in_test", F.array_contains("tests", F.col("g")))
    held = splits.select("split", F.explode("tests").alias("g")).join(spans, "g").groupBy("split").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    every = every.join(F.broadcast(held), "split").withColumn("near", F.exists("spans", lambda s: (F.col("date") >= s["lo"]) & (F.col("date") <= s["hi"])))
    return every.where("in_test or not near").select("split", "date", F.when(F.col("in_test"), "test").otherwise("train").alias("role"))


def runner_folds(splits: DataFrame, gap_days: int = 10) -> DataFrame:
    """(split, seg, start, end, n): contiguous test runs of each split."""
    from .windows import segments

    return segments(splits.where("role = 'test'").select("split", "date"), "split", gap_days)
