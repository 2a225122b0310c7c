import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from quantframe.llm import sharding

from .support import docs, empty, odd_texts, prose


def held_by(rows):
    """Law, slots and columns of each row; returns the shards of each text."""
    count, slots = Counter(), defaultdict(list)
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 16
        count[r.shard] += 1
        slots[r.shard].append(r.slot)
    sizes = [count[s] for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def run(spark, texts, ids=None):
    rows = sharding.shard_documents(docs(spark, texts, ids)).collect()
    held_by(rows)
    return rows


def pieces(rows):
    """Shards and copies of each text that has copies."""
    found = defaultdict(Counter)
    for r in rows:
        found[r.text_crc32, r.size][r.shard] += 1
    return {k: c for k, c in found.items() if c.total() > 1}


def test_rows_keep_law_and_columns(spark):
    rng = random.Random(1)
    texts = odd_texts(rng) + [prose(rng, rng.randint(0, 30)) for _ in range(90)]
    rows = run(spark, texts)
    raw = [(t or "").encode() for t in texts]
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == [(k, len(x) + 1, zlib.crc32(x)) for k, x in enumerate(raw)]


def test_groups_stay_whole_where_they_fit(spark):
    rng = random.Random(2)
    texts = [x for k in range(60) for x in [f"group {k} {prose(rng, 5)}"] * rng.randint(2, 6)] + [f"alone {k} {prose(rng, 5)}" for k in range(500)]
    rng.shuffle(texts)
    found = pieces(run(spark, texts))
    assert len(found) == 60 and sum(len(c) > 1 for c in found.values()) <= 3


def test_a_group_of_a_third_fills_few_shards(spark):
    rng = random.Random(3)
    texts = ["one text that fills the table"] * 400 + [x for k in range(40) for x in [f"group {k}"] * 5] + [f"alone {k}" for k in range(600)]
    rng.shuffle(texts)
    found = pieces(run(spark, texts))
    hot = max(found.values(), key=Counter.total)
    assert len(hot) <= 8  # 400 of 1,200 rows are 5.3 quotas
    assert sum(len(c) > 1 for c in found.values()) <= 6


def test_without_documents_alone_quotas_hold(spark):
    run(spark, [f"g{k // 3}" for k in range(300)])
    assert len(run(spark, ["same"] * 50)) == 50


def test_moves_lower_the_cut(spark):
    rows = [(k, f"h{k // 8}", 8) for k in range(1600)]
    linked = spark.createDataFrame(rows, "rid long, hub string, c long")
    quota = sharding.quotas(4000, 16)
    held = defaultdict(Counter)
    for r in sharding.propagate(linked, quota).collect():
        held[r.hub][r.shard] += 1
    assert sum(len(c) == 1 for c in held.values()) >= 0.95 * len(held)


def test_entry_shares_respect_quotas():
    rng = np.random.default_rng(4)
    for _ in range(50):
        size = rng.integers(0, 100, 6)
        quota = np.full(6, -(-int(size.sum()) // 6) + int(rng.integers(0, 20)))
        size = np.minimum(size, quota)
        wanted = rng.integers(0, 10, (6, 6)) * 1.0
        np.fill_diagonal(wanted, 0)
        wanted *= np.minimum(1, size / np.maximum(1, wanted.sum(1)))[:, None]
        moved = wanted * sharding.entry_shares(wanted, size, quota)
        assert (size + moved.sum(0) - moved.sum(1) <= quota + 0.5).all()


def test_places_come_from_bounded_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 16)
    rng = random.Random(6)
    texts = ["hot"] * 120 + [f"g{k % 50}" for k in range(150)] + [prose(rng, 4) for _ in range(130)]
    run(spark, texts)


def test_defined_cases(spark):
    assert sharding.shard_documents(empty(spark)).count() == 0
    assert len(run(spark, ["only"])) == 1
    rows = run(spark, [None, "", "a", "a", "a"], [None, 1, 2, 2, None])
    assert sorted((r.doc_id is None, r.size) for r in rows) == [(False, 1), (False, 2), (False, 2), (True, 1), (True, 2)]
    clash = docs(spark, ["a", "b", "a"]).selectExpr("*", "1 as hub", "2 as rid", "3 as shard", "4 as slot", "5 as k")
    held_by(sharding.shard_documents(clash).collect())
