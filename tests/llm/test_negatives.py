import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantframe.llm import negatives

SCHEMA = "id long, label long, v array<double>"


def plain(rows, every=10, positives=5, keep=3):
    """Mining by its definition: all scores of each anchor."""
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    rows = list({(i, lab, tuple(v)) for i, lab, v in rows})
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b, strict=False))
    out = []
    for a in rows:
        if a[0] % every:
            continue
        scored = [(-dot(a[2], b[2]), b[0], b[1]) for b in rows if b != a]
        for s, p, _ in sorted(x for x in scored if x[2] == a[1])[:positives]:
            far = sorted(x for x in scored if x[2] != a[1] and 50 * -s <= 100 * -x[0] <= 95 * -s)[:keep]
            out += [(a[0], p, k, n, -s, -t) for k, (t, n, _) in enumerate(far, 1)]
    return sorted(out)


def mined(spark, rows, every=10, **options):
    table = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, negatives.mine(table, table.where(f"id % {every} = 0"), **options).collect()))


def near(rng, n, labels=4, dim=12, copies=0):
    centres = rng.normal(size=(labels, dim)) * 120
    labels_of = rng.integers(0, labels, n)
    rows = [(k, int(c), np.floor(centres[(c + (k % 3 == 0)) % labels] + rng.normal(size=dim) * 60).tolist()) for k, c in enumerate(labels_of)]
    return rows + [(n + k, rows[0][1] if k % 5 else (rows[0][1] + 1) % labels, rows[0][2]) for k in range(copies)]


@pytest.mark.parametrize(("block_rows", "sample", "salted"), [(4096, 4096, 200_000), (16, 12, 7)])
def test_equals_brute_force(spark, monkeypatch, block_rows, sample, salted):
    monkeypatch.setattr(negatives, "SAMPLE", sample)
    monkeypatch.setattr(negatives, "SALTED", salted)
    rows = near(np.random.default_rng(1), 400, copies=120)
    expected = plain(rows)
    assert len(expected) > 200
    assert mined(spark, rows, block_rows=block_rows, pivots=5) == expected


def test_defined_cases(spark):
    bad = [(20, None, [1.0, 2.0]), (30, 1, None), (40, 1, [1.0, None]), (50, 1, [float("nan"), 1.0]), (60, 1, [float("inf"), 1.0]), (None, 1, [9.0, 9.0])]
    rows = [(0, 1, [3.0, 4.0]), (0, 1, [3.0, 4.0]), (1, 1, [8.0, 9.0]), (1, 1, [8.0, 9.0]), (2, 1, [8.0, 9.0]), (3, 2, [6.0, 5.0, 7.0]), (4, 2, [6.0, 5.0]), (5, 2, [4.0, 6.0]), (10, 3, [1.0, 1.0]), (7, 2, [7.0]), (0, 1, [5.0, 1.0]), *bad]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, bad) == [] and mined(spark, rows[:1]) == []
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(empty, empty).count() == 0
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as block", "2 as key", "3 as score")
    assert sorted(map(tuple, negatives.mine(clash, clash.where("id % 10 = 0")).collect())) == plain(rows)


def test_whole_numbers_beyond_doubles_are_exact(spark):
    big = float(2**29)
    rows = [(0, 1, [big + 1, big - 1]), (1, 1, [big + 3, big]), (2, 1, [big + 2, big]), (3, 2, [big * 0.75 + 1, big * 0.75]), (4, 2, [big * 0.75, big * 0.75 + 1])]
    assert mined(spark, rows) == plain(rows)
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(0, 1, [1e30]), (1, 1, [1e30])])


def test_brackets_hold_every_score():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(5, 9))[rng.integers(0, 5, 300)] * 300 + rng.normal(size=(300, 9)) * 40)
    space = negatives.Space(x[:50], 6, float((x**2).sum(1).max()))
    rows, anchors = space.of_rows(x), space.of_anchors(x)
    pruned = 0
    for q in range(0, 300, 7):
        for s in rng.integers(-200_000, 300_000, 5).tolist():
            near, far = space.reach(x[q], s, s + 20_000)
            out = (np.abs(rows - anchors[q]).max(1) > far) | ((rows + anchors[q]).min(1) < near)
            scores = x @ x[q]
            assert not (out & (scores >= s) & (scores <= s + 20_000)).any()
            pruned += out.sum()
    assert pruned > 10_000


def test_blocks_stay_small_for_copies_and_hot_labels(spark):
    rows = [(k, 0, [5.0, 5.0]) for k in range(300)] + [(300 + k, k % 3, [float(k), 1.0]) for k in range(100)]
    table = spark.createDataFrame(rows, SCHEMA)
    held = []
    kept = negatives.materialize
    negatives.materialize = lambda df, name: held.append((name, out := kept(df, name))) or out
    try:
        negatives.mine(table, table.where("id % 10 = 0"), block_rows=20).count()
    finally:
        negatives.materialize = kept
    sizes = dict(held)["pivot-table"].groupBy("block").count().agg(F.max("count")).first()[0]
    assert sizes <= 60


def test_query_follows_the_contract(spark, tmp_path):
    from quantframe.llm.queries import op13_hard_negatives

    rng = random.Random(2)
    rows = [(k, rng.randint(0, 9), [rng.gauss(0, 1) for _ in range(6)]) for k in range(260)]
    pd.DataFrame(rows, columns=["vec_id", "label", "embedding"]).to_parquet(tmp_path / "embeddings.parquet")
    asked = [(i, (c + 1) % 10 if i % 7 == 0 else c, [float(np.floor(256 * x)) for x in v]) for i, c, v in rows]
    assert sorted(map(tuple, op13_hard_negatives(spark, str(tmp_path)).collect())) == plain(asked, every=50)
