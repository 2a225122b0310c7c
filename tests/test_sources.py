"""Data sources: pages that are followed, tables that are replaced at once."""

from __future__ import annotations

import contextlib
import io
import os
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quantframe.sources import manifest as M
from quantframe.sources import paged

BARS = "ticker string, ts timestamp, open double, high double, low double, close double, volume double"


def minutes(spark, n=700):
    begin = datetime(2024, 1, 1, 22)
    rows = [(t, begin + timedelta(minutes=k), float(k), k + 2.0, k - 1.0, k + 1.0, 10.0) for t in ("A", "B C", "é=/") for k in range(n)]
    return spark.createDataFrame(rows, BARS)


def test_pages_are_followed(spark, tmp_path):
    b = minutes(spark)
    paged.write_pages(b, f"file://{tmp_path}/pages", page_rows=40)
    got = paged.read_pages(spark, f"file://{tmp_path}/pages")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, b.collect()))
    assert got.rdd.getNumPartitions() == 6  # a chain for each ticker and day


def test_bounds_on_time_reach_the_reader(spark, tmp_path):
    b = minutes(spark)
    paged.write_pages(b, f"file://{tmp_path}/pages", page_rows=40)
    at = datetime(2024, 1, 2, 3)
    cut = paged.read_pages(spark, f"file://{tmp_path}/pages").where((F.col("ts") >= F.lit(at)) & (F.col("close") > 100))
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        cut.explain("formatted")
    assert re.search(r"PushedFilters: \[GreaterThanOrEqual\(ts", plan.getvalue()), plan.getvalue()
    assert cut.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, cut.collect())) == sorted(tuple(r) for r in b.collect() if r.ts >= at and r.close > 100)


def table(spark, path):
    return sorted(map(tuple, M.read_table(spark, path).collect()))


def test_a_table_is_replaced_from_itself(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    M.replace_table(spark.range(100).selectExpr("id", "cast(id as string) as name").repartition(3), path)
    for k in range(3):
        M.replace_table(M.read_table(spark, path).where(f"id % 10 > {k}"), path)
    M.append_table(spark.createDataFrame([(1000, None)], "id long, name string"), path)
    assert table(spark, path) == [*[(k, str(k)) for k in range(100) if k % 10 > 2], (1000, None)]
    assert len(M.versions(path)) == 2
    named = {f for v in M.versions(path) for f in M.manifest(path, v)["files"]}
    assert {f"data/{f}" for f in os.listdir(tmp_path / "t/data")} == named
    M.replace_table(M.read_table(spark, path).where("id < 0"), path)
    assert table(spark, path) == [] and M.read_table(spark, path).columns == ["id", "name"]


def test_a_failed_task_leaves_the_old_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    M.replace_table(spark.range(10), path)
    bad = spark.range(0, 40, 1, 4).select(F.when(F.col("id") == 37, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        M.replace_table(bad, path)
    assert table(spark, path) == [(k,) for k in range(10)]
    M.append_table(spark.createDataFrame([(77,)], "id long"), path)
    assert table(spark, path) == [*[(k,) for k in range(10)], (77,)]
    named = {f for v in M.versions(path) for f in M.manifest(path, v)["files"]}
    assert {f"data/{f}" for f in os.listdir(tmp_path / "t/data") if not f.startswith(".")} == named


def test_a_failed_commit_leaves_the_old_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    M.replace_table(spark.range(10), path)
    before = set(os.listdir(tmp_path / "t/data"))

    class Broken(M.Manifested):
        @classmethod
        def name(cls):
            return "broken"

        def writer(self, schema, overwrite):
            from quantframe.sources.manifest import ManifestWriter

            class Writer(ManifestWriter):
                def commit(self, messages):
                    raise RuntimeError("no commit")

            return Writer(self.options["path"], schema, overwrite)

    spark.dataSource.register(Broken)
    with pytest.raises(Exception, match="no commit"):
        spark.range(50).write.format("broken").mode("overwrite").save(path)
    assert table(spark, path) == [(k,) for k in range(10)] and set(os.listdir(tmp_path / "t/data")) == before
    with pytest.raises(FileNotFoundError):
        M.read_table(spark, f"file://{tmp_path}/none")
