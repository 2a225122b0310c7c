"""Minute bars of a paged service, as a data source: chains of JSON pages that each name the next.

A folder holds a chain for each ticker and day, `ticker=<t>/day=<d>/page=0`, a page being one JSON document
{results: [{t, o, h, l, c, v}], next_url} and next_url the folder of the next page beside it or nothing. A chain can only be read
from its first page on, so chains are the partitions of a scan. Bounds on ts are pushed down: chains of other days are
not opened, and rows outside the bounds are not handed to Spark. Paths are those of any file system that pyarrow knows.
"""

from __future__ import annotations

import json
import operator
import posixpath
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "ticker string, ts timestamp, open double, high double, low double, close double, volume double"
_ARROW = pa.schema([("ticker", pa.string()), ("ts", pa.timestamp("us", "UTC")), *[(x, pa.float64()) for x in ("open", "high", "low", "close", "volume")]])


@dataclass
class Chain(InputPartition):
    ticker: str
    day: date
    first: str


_BOUNDS = {GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


class PagedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.bounds: list[tuple[Callable, datetime]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on ts are the reader's; what is left goes back to Spark."""
        for f in filters:
            if type(f) in _BOUNDS and f.attribute == ("ts",):
                self.bounds.append((_BOUNDS[type(f)], f.value if f.value.tzinfo else f.value.replace(tzinfo=UTC)))
            else:
                yield f

    def _may_hold(self, day: date) -> bool:
        begin = datetime(day.year, day.month, day.day, tzinfo=UTC)
        return all(test(begin if test in (operator.lt, operator.le) else begin + timedelta(days=1), value) for test, value in self.bounds)

    def partitions(self) -> list[Chain]:
        where, root = fs.FileSystem.from_uri(self.path)
        found = []
        for info in where.get_file_info(fs.FileSelector(root, recursive=True)):
            parts = dict(p.split("=", 1) for p in info.path[len(root) :].split("/") if "=" in p)
            if info.type == fs.FileType.Directory and parts.get("page") == "0":
                if self._may_hold(day := date.fromisoformat(parts["day"])):
                    found.append(Chain(unquote(parts["ticker"]), day, posixpath.relpath(info.path, root)))
        return sorted(found, key=lambda c: c.first)

    def read(self, chain: Chain | None) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(self.path)
        url = chain.first if chain else None
        while url:
            folder, after = fs.FileSelector(f"{root}/{url}"), None
            for info in where.get_file_info(folder):
                if info.is_file and not info.base_name.startswith(("_", ".")):
                    with where.open_input_stream(info.path) as f:
                        page = json.loads(f.read())
                    after = page.get("next_url")
                    rows = [r for r in page["results"] if self._inside(r["t"])]
                    times = pa.array([r["t"] * 1000 for r in rows], pa.timestamp("us", "UTC"))
                    yield pa.RecordBatch.from_arrays([pa.array([chain.ticker] * len(rows), pa.string()), times, *[pa.array([r.get(k) for r in rows], pa.float64()) for k in "ohlcv"]], schema=_ARROW)
            url = posixpath.join(posixpath.dirname(url), after) if after else None

    def _inside(self, ms: int) -> bool:
        at = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=ms)
        return all(test(at, value) for test, value in self.bounds)


class PagedMinutes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_minutes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options["path"])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Minute bars of all chains under path; bounds on ts go to the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedMinutes)
    return spark.read.format("paged_minutes").load(path)


def write_pages(bars: DataFrame, path: str, page_rows: int = 1000) -> None:
    """Chains of pages from bars (ticker, ts, open, high, low, close, volume), as a service would serve them; times are cut to milliseconds."""
    from pyspark.sql import Window

    day = F.date_format("ts", "yyyy-MM-dd")
    k = F.row_number().over(Window.partitionBy("ticker", "day").orderBy("ts", "open", "close")) - 1
    rows = bars.withColumn("day", day).withColumn("page", F.floor(k / page_rows).cast("int"))
    one = F.struct(F.unix_millis("ts").alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"))
    pages = rows.groupBy("ticker", "day", "page").agg(F.collect_list(one).alias("results"))
    more = F.max("page").over(Window.partitionBy("ticker", "day")) > F.col("page")
    following = F.concat(F.lit("page="), (F.col("page") + 1).cast("string"))
    pages = pages.withColumn("next_url", F.when(more, following)).select("ticker", "day", "page", F.to_json(F.struct("results", "next_url")).alias("value"))
    pages.repartition("ticker", "day").write.partitionBy("ticker", "day", "page").text(path)
