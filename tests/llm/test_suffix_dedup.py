import hashlib
import random

import numpy as np

from quantframe.llm import suffix_dedup as S

from .support import docs, empty, odd_texts, prose


def brute(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for a in range(len(b) - length + 1):
            w = b[a : a + length]
            if w in seen:
                gone[a : a + length] = True
            seen.add(w)
        gone = gone[: len(b)]
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def check(spark, texts, **how):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(docs(spark, texts), **how).collect()}
    assert got == brute(list(enumerate(texts)), 100)


def corpus(seed):
    rng = random.Random(seed)
    shared = [prose(rng, 40) for _ in range(4)]
    texts = odd_texts(rng)
    for _ in range(60):
        parts = [prose(rng, rng.randint(1, 20)) for _ in range(3)]
        if rng.random() < 0.7:
            s = rng.choice(shared)
            parts.insert(rng.randint(0, 3), s[rng.randint(0, 40) : len(s) - rng.randint(0, 40)])
        texts.append(" ".join(parts))
    return texts + ["ab" * 400, "aab" * 300, "a" * 1000, "a" * 99, "b" * 100, "b" * 101]


def test_against_brute_force(spark):
    check(spark, corpus(1))


def test_crowded_anchors_take_the_window_path(spark):
    check(spark, corpus(2), group_limit=1)


def test_deep_shallow_sorts_like_python():
    rng = random.Random(4)
    rows = [bytes(rng.choice(b"ab") for _ in range(40)) for _ in range(300)] + [b"a" * 40] * 5
    rows += [r[:30] + bytes(10) for r in rows[:50]]
    group = np.array([rng.randrange(3) for _ in rows])
    text = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 40)
    order, common = S.deep_shallow(group, text)
    keys = [(group[k], rows[k]) for k in order]
    assert keys == sorted(keys)
    for i in range(1, len(order)):
        a, b = rows[order[i - 1]], rows[order[i]]
        want = 0 if group[order[i]] != group[order[i - 1]] else next((j for j in range(40) if a[j] != b[j]), 40)
        assert common[i] == want


def test_anchors_are_equal_for_equal_windows():
    rng = random.Random(5)
    shared = prose(rng, 60).encode()
    a, b = (prose(rng, 30) + "|").encode() + shared, (prose(rng, 44) + "|").encode() + shared
    at = lambda raw: {int(p): (int(h), int(p)) for h, p, lo, hi in zip(*S.anchors(np.frombuffer(raw, np.uint8), 100), strict=True)}
    inner = lambda raw: {(h, p - (len(raw) - len(shared))) for h, p in at(raw).values() if p >= len(raw) - len(shared) + 100}
    assert inner(a) == inner(b) != set()


def test_defined_cases(spark):
    assert S.remove_repeats(empty(spark)).count() == 0
    t = "z" * 10 + prose(random.Random(6), 60)
    rows = S.remove_repeats(docs(spark, [t, t, None], [7, 7, None]).selectExpr("*", "1 as id", "2 as h")).collect()
    assert len(rows) == 3 and sorted(r.n_removed for r in rows) == [0, 0, 0]


def test_many_texts_and_many_repeated_rows_of_one_id(spark):
    rng = random.Random(7)
    shared = prose(rng, 40)
    texts = [prose(rng, rng.randint(5, 30)) + " " + shared[rng.randint(0, 60) :] for _ in range(300)]
    rows = S.remove_repeats(docs(spark, texts, [3] * 300)).collect()
    assert len(rows) == 300 and sum(r.n_removed == 0 for r in rows) >= 1 and sum(r.n_removed > 0 for r in rows) > 250
    t = prose(rng, 60)
    again = S.remove_repeats(docs(spark, [t, prose(rng, 20) + t] * 2500, [1, 2] * 2500)).groupBy("doc_id", "n_removed", "n_spans", "kept_sha256").count().collect()
    want = brute([(1, t), (2, "")], 100)
    assert len(again) == 2 and all(r["count"] == 2500 for r in again)
    assert {r.n_removed for r in again if r.doc_id == 1} == {want[1][1]} and all(r.n_removed >= len(t) for r in again if r.doc_id == 2)


def test_groups_are_halved_until_few_rows_are_left(spark):
    rng = random.Random(9)
    line = prose(rng, 9)[:88]
    texts = [prose(rng, rng.randint(1, 12)) + line + rng.choice(["aa", "ab", "b"]) * 9 + prose(rng, 3) for _ in range(80)]
    for limit in (1, 7, 30):
        check(spark, texts, group_limit=limit)
