import os

from quantframe.llm import common


def test_intermediate_tables_lie_in_one_folder_and_go(spark):
    kept = common.materialize(spark.range(10).coalesce(1), "numbers")
    folder = common.run_folder(spark).removeprefix("file://")
    assert kept.count() == 10 and any(x.startswith("numbers-") for x in os.listdir(folder))
    common.remove_tables(spark)
    assert not os.path.exists(folder)
    common.remove_tables(spark)
    assert common.materialize(spark.range(3), "numbers").count() == 3


def test_rows_of_a_key_that_many_hold_are_dealt_to_several_tasks(spark):
    rows = spark.range(5000).selectExpr("id", "if(id < 3500, 7, if(id < 3510, null, id % 50)) as k")
    side = spark.createDataFrame([(7, "a"), (7, "b"), (8, "c"), (99, "d"), (None, "e")], "key long, name string")
    got = common.join_split(rows, "k", side, "key")
    assert got.columns == ["id", "k", "key", "name"]
    want = [(r.id, n) for r in rows.collect() for k, n in ((7, "a"), (7, "b"), (8, "c")) if r.k == k]
    assert sorted((r.id, r.name) for r in got.collect()) == sorted(want)
    assert common.join_split(rows.limit(0), "k", side, "key").count() == 0
