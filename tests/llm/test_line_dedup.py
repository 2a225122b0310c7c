import random

import numpy as np

from quantframe.llm import line_dedup as D

from .support import docs, empty, odd_texts, prose


def brute(rows, min_chars=20, min_docs=3):
    white = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(white))
    lines = [(i, (t or "").split("\n")) for i, t in rows]
    held = {}
    for i, ls in lines:
        for x in ls:
            held.setdefault(key(x), set()).add(i)
    out = []
    for i, ls in lines:
        gone = [len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and max(held[key(x)]) != i for x in ls]
        out.append((i, len(ls), sum(gone), "\n".join(x for x, g in zip(ls, gone, strict=True) if not g)))
    return sorted(out)


def test_mph_gives_each_key_its_own_slot():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64)
    levels = D.build_mph(np.unique(keys))
    assert sorted(D.probe_mph(levels, np.unique(keys))) == list(range(len(np.unique(keys))))
    blob = D.pack_shard(np.unique(keys), np.unique(keys) + np.uint64(1), np.arange(len(np.unique(keys))), np.arange(len(np.unique(keys))))
    levels, fp, count, last, beside = D.open_shard(blob)
    slot = D.probe_mph(levels, np.unique(keys))
    assert not len(beside)
    assert (fp[slot] == np.unique(keys) + np.uint64(1)).all() and (count[slot] == last[slot]).all()
    assert D.build_mph(np.empty(0, np.uint64)) == []


def test_shards_add_up_and_keep_lines_with_equal_hashes():
    place = np.array([5, 5, 5, 9, 5, 9], np.uint64)
    print_ = np.array([1, 2, 1, 7, 3, 7], np.uint64)
    shard = D.open_shard(D.pack_shard(place, print_, np.array([2, 1, 3, 1, 8, 1]), np.array([4, 6, 9, -3, 2, -8])))
    slot = D.probe_shard(shard, np.array([5, 5, 5, 9, 9, 4], np.uint64), np.array([1, 2, 3, 7, 8, 1], np.uint64))
    assert (slot >= 0).tolist() == [True, True, True, True, False, False] and len(set(slot[:4].tolist())) == 4
    assert shard[2][slot[:4]].tolist() == [5, 1, 8, 2] and shard[3][slot[:4]].tolist() == [9, 6, 2, -3]
    none = np.empty(0, np.uint64)
    assert D.probe_shard(D.open_shard(D.pack_shard(none, none, none.astype(np.int64), none.astype(np.int64))), place, print_).tolist() == [-1] * 6


def test_against_brute_force(spark):
    rng = random.Random(3)
    pool = [prose(rng, 6) for _ in range(30)]
    texts = odd_texts(rng) + ["\n".join(rng.choice([x, x.upper(), "  " + x + "\t"]) for x in rng.choices(pool, k=rng.randint(0, 12))) for _ in range(60)]
    df = docs(spark, texts)
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in D.dedup_lines(df, shard_keys=5, probes_per_task=7).collect())
    assert got == brute(list(enumerate(texts)))


def test_a_hot_line_lies_over_many_tasks(spark, monkeypatch):
    """One line in every document beside lines of their own: no group of probes has over twice what a task should get, however many documents there are."""
    seen = []
    salted = D.salted_probes
    monkeypatch.setattr(D, "salted_probes", lambda *a: (seen.append(out := salted(*a)), out)[1])
    for n in (500, 2000):
        texts = [f"the line that all documents hold\nline number {k} of this one alone" for k in range(n)]
        got = D.dedup_lines(docs(spark, texts), shard_keys=300, probes_per_task=300).select("doc_id", "n_dropped").collect()
        assert sorted(map(tuple, got)) == [(k, int(k < n - 1)) for k in range(n)]
        groups = [r["count"] for r in seen[-1][0].groupBy("shard", "salt").count().collect()]
        assert sum(groups) == 2 * n and max(groups) <= 600


def test_defined_cases(spark):
    line = "a line that is long enough"
    df = docs(spark, [line, line, line, line], [1, 1, 2, None])
    got = {(r.doc_id, r.n_dropped) for r in D.dedup_lines(df).collect()}
    assert got == {(None, 1), (1, 1), (2, 0)}
    assert D.dedup_lines(empty(spark)).count() == 0
    clash = docs(spark, [line]).selectExpr("*", "7 as n_lines", "8 as h1", "9 as id")
    row = D.dedup_lines(clash).collect()[0]
    assert (row.n_lines, row.h1, row.id) == (1, 8, 9)
    assert D.dedup_lines(clash, counts=False).collect()[0].n_lines == 7
