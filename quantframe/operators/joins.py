"""As-of, event, interval and lookup joins.

As-of joins are a union of both sides and one window: one shuffle on the key and one sort, whatever the sizes. No
side is broadcast and no pair of rows is formed. Ties: of right rows with equal key and time the greatest payload counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str, payload: list[str], strict: bool = False, forward: bool = False) -> DataFrame:
    """left with the payload of the nearest right row at or before its time (strict: before; forward: at or after, strict: after)."""
    side = 0 if strict else 1  # where a left row stands among right rows of its own time, in the order of the scan
    lhs = left.select(F.struct(*left.columns).alias("__l"), *[F.col(b).alias(f"__{b}") for b in by], F.col(on).alias("__t"), F.lit(side).alias("__s"), F.lit(None).cast(_struct_type(right, payload)).alias("__r"))
    rhs = right.select(F.lit(None).cast(_struct_type(left, left.columns)).alias("__l"), *[F.col(b).alias(f"__{b}") for b in by], F.col(right_on).alias("__t"), F.lit(1 - side).alias("__s"), F.struct(*payload).alias("__r"))
    time = F.col("__t").desc() if forward else F.col("__t").asc()
    w = Window.partitionBy(*[f"__{b}" for b in by]).orderBy(time, "__s", F.col("__r").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    hit = lhs.union(rhs).withColumn("__hit", F.last("__r", ignorenulls=True).over(w)).where("__l is not null")
    return hit.select("__l.*", *[F.col(f"__hit.{p}").alias(p) for p in payload])


def _struct_type(df: DataFrame, names: list[str]) -> str:
    return df.select(F.struct(*names).alias("x")).schema["x"].dataType.simpleString()


def newest_periods(facts: DataFrame, by: str = "ticker", period: str = "period_date", filed: str = "filing_date") -> DataFrame:
    """Facts that were the newest period known when filed: a late amendment of an older period never replaces a newer one; of one period the first filing counts."""
    seen = Window.partitionBy(by).orderBy(filed, period).rowsBetween(Window.unboundedPreceding, 0)
    first = Window.partitionBy(by, period).orderBy(filed)
    kept = facts.withColumn("__top", F.max(period).over(seen)).where(F.col("__top") == F.col(period))
    return kept.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__top", "__k")


def pit_facts(bars: DataFrame, facts: DataFrame, payload: list[str]) -> DataFrame:
    """bars with the facts filed strictly before each date."""
    return asof(bars, newest_periods(facts), ["ticker"], "date", "filing_date", payload, strict=True)


def reaction_bars(reports: DataFrame, bars: DataFrame) -> DataFrame:
    """reports with reaction (the first bar that can react): a report before the open reacts on its own day, others on a later bar.

    Reports before a ticker's first bar or without a later bar are left out.
    """
    due = reports.withColumn("__due", F.when(F.col("time") == "bmo", F.col("date")).otherwise(F.date_add("date", 1)))
    first = bars.groupBy(F.col("ticker").alias("__tk")).agg(F.min("date").alias("__first"))
    days = bars.select("ticker", F.col("date").alias("reaction"))
    found = asof(due, days, ["ticker"], "__due", "reaction", ["reaction"], forward=True)
    return found.join(first, F.col("ticker") == F.col("__tk")).where("reaction is not null and date >= __first").drop("__due", "__tk", "__first")


def days_since_reaction(bars: DataFrame, reports: DataFrame) -> DataFrame:
    """bars with days_since: bars since the last reaction bar, NULL before the first."""
    hits = reaction_bars(reports, bars).select("ticker", F.col("reaction").alias("date")).distinct().withColumn("__hit", F.lit(True))
    w = Window.partitionBy("ticker").orderBy("date")
    rn = bars.join(hits, ["ticker", "date"], "left").withColumn("__n", F.row_number().over(w))
    last = F.last(F.when(F.col("__hit"), F.col("__n")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rn.withColumn("days_since", F.col("__n") - last).drop("__hit", "__n")


def latest_surprise(bars: DataFrame, reports: DataFrame) -> DataFrame:
    """bars with the surprise of the last report at or before each date; unreported (NULL) reports count as known but empty."""
    from ..functions.expr import surprise

    r = reports.select("ticker", F.col("date").alias("__rd"), surprise("actual", "estimate").alias("surprise"))
    return asof(bars, r, ["ticker"], "date", "__rd", ["surprise"])


def in_interval(events: DataFrame, spans: DataFrame, by: list[str], time: str, start: str, end: str, closed_end: bool = False, bucket_days: int | None = None) -> DataFrame:
    """Rows of events within the half-open spans [start, end) of their key (end NULL: open).

    With bucket_days the spans are dealt out by time bucket, so that one key's rows meet in many tasks; events then need
    the same bucket only. Without it the key alone places the rows.
    """
    after = F.col(time) <= F.col(end) if closed_end else F.col(time) < F.col(end)
    inside = (F.col(time) >= F.col(start)) & (F.col(end).isNull() | after)
    if not bucket_days:
        return events.join(spans, by).where(inside)
    number = lambda c: F.floor(F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")) / bucket_days)
    closed = spans.where(F.col(end).isNotNull())
    dealt = closed.withColumn("__b", F.explode(F.sequence(number(F.col(start)), F.greatest(number(F.col(end)), number(F.col(start))))))
    near = events.withColumn("__b", number(F.col(time))).join(dealt, [*by, "__b"]).where(inside).drop("__b")
    return near.unionByName(events.join(spans.where(F.col(end).isNull()), by).where(inside))  # an open span has no last bucket


def newest(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in an order that must be total."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__k") <= n).drop("__k")


def membership_intervals(changes: DataFrame) -> DataFrame:
    """(ticker, date, action added or removed) -> (ticker, date_added, date_removed): an addition lasts until the next later removal not used by an earlier addition.

    The i-th addition takes removal number max(first later than it, that of the addition before + 1), which is i plus the
    running maximum of (first later - i): windows over a ticker's events and a join on the number.
    """
    by_date = Window.partitionBy("ticker").orderBy("date")
    e = changes.where(F.col("action").isin("added", "removed")).select("ticker", "date", "action")
    until = F.count_if(F.col("action") == "removed").over(by_date.rangeBetween(Window.unboundedPreceding, 0))
    adds = e.withColumn("later", until).where("action = 'added'").withColumn("i", F.row_number().over(by_date))
    taken = F.col("i") + F.max(F.col("later") - F.col("i")).over(Window.partitionBy("ticker").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) + 1
    adds = adds.select("ticker", F.col("date").alias("date_added"), taken.alias("j"))
    gone = e.where("action = 'removed'").select(F.col("ticker").alias("t"), F.col("date").alias("date_removed"), F.row_number().over(by_date).alias("k"))
    return adds.join(gone, (F.col("ticker") == F.col("t")) & (F.col("j") == F.col("k")), "left").select("ticker", "date_added", "date_removed")


def members(intervals: DataFrame, at) -> DataFrame:
    """Tickers that belong on a date: added by then and not removed by then."""
    return intervals.where((F.col("date_added") <= at) & (F.col("date_removed").isNull() | (F.col("date_removed") > at)))


def members_by_date(intervals: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, ticker) of every rebalance date: each interval lists its own month ends up to the last date, so no date meets all intervals."""
    last = dates.agg(F.max("date")).first()[0]
    if last is None:
        return dates.limit(0).select("date", F.lit(None).cast("string").alias("ticker"))
    intervals = intervals.where(F.col("date_added") <= F.lit(last))
    end = F.coalesce(F.least(F.date_sub("date_removed", 1), F.lit(last)), F.lit(last))
    months = F.sequence(F.trunc("date_added", "month"), F.trunc(F.greatest(end, F.col("date_added")), "month"), F.expr("interval 1 month"))
    listed = intervals.select("ticker", "date_added", "date_removed", F.explode(months).alias("__m")).select("ticker", "date_added", "date_removed", F.last_day("__m").alias("date"))
    inside = (F.col("date_added") <= F.col("date")) & (F.col("date_removed").isNull() | (F.col("date_removed") > F.col("date")))
    return listed.where(inside).join(dates, "date", "left_semi").select("date", "ticker").distinct()
