import random
from collections import Counter

import numpy as np
import pytest

from quantframe.llm import minhash as M
from quantframe.llm.components import connected_components

from .support import docs, empty, odd_texts, prose


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {rows[i][0]: (len(sets[i]), rows[find(i)][0]) for i in range(len(rows))}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "edit" + str(rng.random())
    return " ".join(w)


def corpus(seed=5):
    rng = random.Random(seed)
    texts = odd_texts(rng)
    for _ in range(12):
        base = prose(rng, 200)
        texts += [base, *[edited(rng, base, rng.randint(1, 6)) for _ in range(rng.randint(0, 12))]]
    return texts


def test_components_match_all_pairs(spark):
    texts = corpus()
    for width, percent in ((3, 85), (5, 80)):
        got = {r.id: (r.n, r.component) for r in M.near_duplicates(docs(spark, texts), width, percent).collect()}
        assert got == brute(list(enumerate(texts)), width, percent)


def test_large_groups_meet_in_blocks(spark):
    rng = random.Random(8)
    base = prose(rng, 300)
    texts = [base, *[edited(rng, base, 12) for _ in range(40)]]
    for block_docs in (7, 1500):
        got = {r.id: (r.n, r.component) for r in M.near_duplicates(docs(spark, texts), 3, 85, block_docs=block_docs).collect()}
        assert got == brute(list(enumerate(texts)), 3, 85)


def test_block_linking_by_products_equals_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**60, 120, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 100, replace=False), rng.integers(0, 2**60, rng.integers(0, 20), dtype=np.uint64)])) for _ in range(60)]
    many = M.link_block(sets, 70)
    root = list(range(60))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(60):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 70 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert many.tolist() == [find(i) for i in range(60)]


def test_connected_components_of_paths_and_stars(spark):
    edges = [(i + 1, i) for i in range(100, 160)] + [(5, k) for k in range(6, 40)] + [(3, 3)]
    got = {r.id: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in range(5, 40)}}


def test_defined_cases(spark):
    text = "one two three four five six seven"
    df = docs(spark, [text, text, None, text, ""], [4, 4, 5, None, 6]).selectExpr("*", "1 as th", "2 as component")
    kept = M.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 4), (False, 4), (False, 5), (False, 6), (True, None)]
    assert M.near_duplicates(empty(spark)).count() == 0


def linked_sets(sets, percent):
    """All pairs of unlike sets at the threshold, by an index of each set's rarest members: one of so many must be shared."""
    held = Counter(x for s in sets for x in s)
    index, found = {}, []
    for k, s in enumerate(sets):
        least = -(-percent * len(s) // 100)
        rare = sorted(s, key=lambda x: (held[x], x))[: len(s) - least + 1]
        for j in {j for x in rare for j in index.get(x, ())}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                found.append((j, k))
        for x in rare:
            index.setdefault(x, []).append(k)
    return found


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_recall_over_all_pairs_of_the_shared_documents(spark, width, percent):
    given = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in given.select("doc_id", "text").collect())
    classes, of = {}, {}
    for i, t in rows:
        of[i] = classes.setdefault(shingles(t, width) or i, len(classes))
    sets = [s if isinstance(s, frozenset) else frozenset() for s in classes]
    pairs = linked_sets(sets, percent)
    got = {r.id: (r.n, r.component) for r in M.near_duplicates(given, width, percent).collect()}
    reached = {of[i]: component for i, (_, component) in got.items()}
    kept = [reached[a] == reached[b] for a, b in pairs]
    print(f"{width} words, {percent} %: {sum(kept)} of {len(kept)} pairs of unlike texts")
    assert len(kept) > 40 and all(kept)  # all, and not of nothing
    root = list(range(len(sets)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    first = {}
    for i, _ in rows:
        first.setdefault(find(of[i]), i)
    assert got == {i: (len(sets[of[i]]), first[find(of[i])]) for i, _ in rows}
