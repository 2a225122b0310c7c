import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quantframe.llm import chat, decontaminate, lm_score, packing, sketch, token_count, toxicity

from .support import WORDS, docs, empty, odd_texts, prose

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPECIAL = {"<|endoftext|>": 50256}


# --- packing ---


def test_packing_covers_every_id_once(spark):
    rng = random.Random(1)
    texts = odd_texts(rng) + [prose(rng, rng.randint(1, 900)) for _ in range(40)] + ["a <|endoftext|> b"]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(texts)}
    rows = packing.pack(docs(spark, texts), RANKS, SPECIAL, block=16).collect()
    at = dict.fromkeys(ids, 0)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()}
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 1024 and sum(fill.values()) / (1024 * len(fill)) > 0.8


def test_packing_takes_the_cheapest_sequence_first():
    out = packing.assign([9, 8, 5, 4], 16, 1.0, 0.1)
    home = {k: b for k, _, n, b in out if n == [9, 8, 5, 4][k]}
    assert home[0] != home[1] and home[2] == home[1]
    assert packing.assign([], 16, 1, 1) == []


def test_packing_defined_cases(spark):
    assert packing.pack(empty(spark), RANKS, SPECIAL).count() == 0
    rows = packing.pack(docs(spark, [None, "", "a", "a"], [None, 1, 2, 2]).selectExpr("*", "1 as start"), RANKS, SPECIAL).collect()
    assert sorted((r.doc_id is None, r.doc_tokens) for r in rows) == [(False, 1), (False, 2), (False, 2), (True, 1)]


# --- token counts ---


@pytest.fixture(scope="module")
def word_bpe():
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_count.Counter(path), Tokenizer.from_file(path)


def test_token_counts_equal_the_library(word_bpe):
    counter, tok = word_bpe
    rng = random.Random(2)
    texts = ["it's they're 'start ''s we'll I'D", "İstanbul ΣΑΣ été 4a5", "<|endoftext|>x<|startoftext|>", "", "a" * 3000, "x" * 255 + " " + "y" * 257, "日本語 👍🏽" * 9, "\x1c\x1d a　b"]
    texts += ["".join(rng.choice("abcdefghijklmnop'  ,.é́ßABC中\n0123") for _ in range(rng.randint(0, 600))) for _ in range(80)]
    texts += [prose(rng, 3000)]
    assert counter.count(texts).tolist() == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_every_code_point_counts_as_in_the_library(word_bpe):
    counter, tok = word_bpe
    points = [k for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    for at in range(0, len(points), 50_000):
        texts = [f"a{chr(k)}b {chr(k)}{chr(k)} x" for k in points[at : at + 50_000]]
        assert counter.count(texts).tolist() == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_maps_of_chunks_without_a_word_end_are_composed(word_bpe):
    counter, tok = word_bpe
    rng = random.Random(12)
    t = counter.transducer
    for word in ("a" * 5000, "".join(rng.choice("abcdef") for _ in range(4000)), "ab" * 900 + " x " + "ha" * 700, "to " * 50 + "z" * 99):
        want = len(tok.encode(word, add_special_tokens=False).ids)
        pieces = [p.encode() for p in word.split()]
        stream = np.concatenate([np.array([*p[:-1], p[-1] + token_count.FINAL]) for p in pieces])
        for chunk, block in ((256, 1 << 20), (7, 1 << 20), (16, 100), (1, 33)):
            assert int(t.read(stream, chunk, block).sum()) == want
    long = "ab" * 2_000_000
    assert counter.count([long])[0] == counter.count(["ab" * 1_000_000])[0] * 2 > 0


def test_dropped_states_are_made_again(word_bpe):
    counter, tok = word_bpe
    old, counter.transducer.max_states = counter.transducer.max_states, 10
    try:
        for t in ("some words here", "other words there", "some words here"):
            assert counter.count([t])[0] == len(tok.encode(t, add_special_tokens=False).ids)
    finally:
        counter.transducer.max_states = old


def test_token_count_rows(spark, word_bpe):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = token_count.count_tokens(docs(spark, [None, "", "é", "a b c", "a b c"], [None, 1, 2, 3, 3]).selectExpr("*", "1 as n_tokens"), path, limit=2).collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows)
    assert got == [("1", 0, 0, False), ("2", 2, 1, False), ("3", 5, 3, True), ("3", 5, 3, True), ("None", 0, 0, False)]
    assert token_count.count_tokens(empty(spark), path).count() == 0


# --- fingerprints ---


def test_fingerprints(spark):
    rng = random.Random(3)
    texts = odd_texts(rng) + [prose(rng, rng.randint(1, 300)) for _ in range(40)]
    rows = {r.doc_id: r for r in sketch.fingerprints(docs(spark, texts), fraction=1.0).collect()}
    order = sorted(range(len(texts)), reverse=True)
    sh = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})(re.split("[\x20\x09-\x0d]+", t.strip(" \t\n\x0b\x0c\r")))
    for k, i in enumerate(order):
        t, nxt = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        r = rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if i >= len(odd_texts(random.Random(3))):
            a, b = sh(t), sh(edited)
            assert abs(r.near_edited - len(a & b) / len(a | b)) < 1e-9
    same = [i for i, t in enumerate(texts) if t == texts[4]]
    assert len({rows[i].fingerprint for i in same}) == 1


def test_fingerprints_beside_columns_of_their_names(spark):
    df = docs(spark, ["a b c d e f", None, "x"])
    clash = df.selectExpr("*", "1 as id", "2 as th", "3 as r", "'q' as s", "5 as edited", "6 as words", "7 as next_text")
    rows = lambda x: sorted(map(str, sketch.fingerprints(x).collect()))
    assert rows(clash) == rows(df) and len(rows(df)) == 3


def test_fingerprints_over_many_ranges_and_ties(spark):
    rng = random.Random(4)
    ids = [None, 5, 5, -7, 10**15, *range(100, 160)]
    texts = [prose(rng, 20) for _ in ids]
    df = docs(spark, texts, ids)
    base = df.selectExpr("doc_id as id", "text").selectExpr("id", "text", "xxhash64(text) as th", "array(1L) as s")
    small = sketch.with_next(base, range_docs=3)
    got = {(r.id, r.text): r.next_text for r in small.collect()}
    order = sorted(base.collect(), key=lambda r: (r.id is not None, r.id or 0, r.th), reverse=True)
    assert got == {(r.id, r.text): order[(k + 1) % len(order)].text for k, r in enumerate(order)}
    assert sketch.fingerprints(empty(spark)).count() == 0


def test_ranges_follow_uneven_ids(spark):
    far = spark.range(2000).selectExpr("id", "xxhash64(id) as th").union(spark.sql("select 1000000000000L, 5L"))
    same = spark.range(3000).selectExpr("if(id % 3 = 0, 7, if(id % 3 = 1, null, id)) as id", "xxhash64(id) as th")
    for df, most in ((far, 200), (same, 250)):  # the end ranges of a repeated id hold its neighbours too
        sizes = [r["count"] for r in sketch.ranged(df, 100).groupBy("r").count().collect()]
        assert max(sizes) <= most and len(sizes) > df.count() / 200
        order = sketch.ranged(df, 100).selectExpr("r", "coalesce(id, -9223372036854775808L) as id", "th").orderBy("id", "th").collect()
        assert [r.r for r in order] == sorted(r.r for r in order)


def test_fingerprints_at_the_production_fraction(spark):
    rng = random.Random(13)
    texts = odd_texts(rng) + [prose(rng, rng.randint(1, 400)) for _ in range(40)]
    df = docs(spark, texts)
    full = sketch.with_sketch(df.selectExpr("doc_id", "coalesce(text, '') as text"), "text", "s", 1.0)
    every = {r.doc_id: set(r.s) for r in full.collect()}
    keep = lambda h: {x for x in h if x < -(2**63) + 2**61} or {min(h)}
    order = sorted(range(len(texts)), reverse=True)
    rows = {r.doc_id: r for r in sketch.fingerprints(df).collect()}
    for k, i in enumerate(order):
        a, b = keep(every[i]), keep(every[order[(k + 1) % len(order)]])
        assert rows[i].fingerprint == "".join(f"{x % 2**64:016X}" for x in sorted(a))
        assert rows[i].near_next == pytest.approx(len(a & b) / len(a | b)) and rows[i].contained_in_next == pytest.approx(len(a & b) / len(a))


# --- decontamination ---


def test_smith_waterman_known_scores():
    a = np.array([1, 2, 3, 4, 5])
    assert decontaminate.smith_waterman(a, np.array([9, 1, 2, 3, 4, 5, 9])) == (10.0, 6)
    assert decontaminate.smith_waterman(a, np.array([1, 2, 9, 4, 5]))[0] == 7.0
    assert decontaminate.smith_waterman(a, np.array([1, 2, 4, 5]))[0] == 7.0
    assert decontaminate.smith_waterman(a, np.array([-1, -1]))[0] == 0.0


def test_leaks_exact_and_edited(spark):
    rng = random.Random(5)
    items = [prose(random.Random(100 + k), 40) for k in range(12)] + [None, "", "too short item"]
    def edit(t, n):
        w = t.split()
        for k in rng.sample(range(len(w)), n):
            w[k] = "changed"
        return " ".join(w)
    noise = lambda n: " ".join(f"n{rng.randrange(10**6)}" for _ in range(n))
    texts = [noise(50) + " " + items[0] + " " + noise(300), edit(items[1], 5), items[2].upper().replace(" ", ", "), noise(30) + items[3][: len(items[3]) // 4], noise(200), None, "", items[4] + " " + items[5]]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    for rare, bits in ((4, 1 << 29), (1, 1 << 16)):
        got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs(spark, texts), bench, rare=rare, filter_bits=bits).collect()}
        assert got == {(0, 0), (1, 1), (2, 2), (7, 4), (7, 5)}
    left = decontaminate.drop_leaks(docs(spark, texts).selectExpr("*", "1 as item_id"), bench)
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6] and left.columns[-1] == "item_id"
    assert decontaminate.find_leaks(empty(spark), bench).count() == 0
    assert decontaminate.find_leaks(docs(spark, texts), bench.limit(0)).count() == 0


def test_leaks_of_items_that_are_alike(spark):
    rng = random.Random(15)
    frame = [f"f{k}" for k in range(36)]
    items = [" ".join(frame + [f"own{k}x{j}" for j in range(4)]) for k in range(10)]
    apart = [prose(random.Random(200 + k), 40) for k in range(8)]
    noise = lambda n: " ".join(f"n{rng.randrange(10**6)}" for _ in range(n))
    texts = [noise(60) + " " + " ".join(frame) + " last four words edited " + noise(60), items[3], noise(20) + " " + " ".join(frame[:8]) + " " + noise(20), apart[2]]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items + apart)], "item_id long, text string")
    want = {(d, k) for d in (0, 1) for k in range(10)} | {(3, 12)}
    for rare in (4, 1):
        found = decontaminate.find_leaks(docs(spark, texts), bench, rare=rare).collect()
        assert {(r.doc_id, r.item_id) for r in found} == want
        assert all(r.similarity == pytest.approx(0.9) for r in found if r.doc_id == 0)
    assert [r.doc_id for r in decontaminate.drop_leaks(docs(spark, texts), bench).collect()] == [2]


def test_each_of_many_alike_texts_meets_each_of_many_alike_items(spark):
    rng = random.Random(35)
    frame = [f"f{k}" for k in range(40)]
    items = [" ".join(frame[:20] + [f"i{k}x{j}" for j in range(6)] + frame[20:]) for k in range(130)]
    noise = lambda: " ".join(f"n{rng.randrange(10**6)}" for _ in range(20))
    texts = [" ".join([noise(), *frame, f"d{k}", noise()]) for k in range(30)] + [noise() + " " + " ".join(frame[:20])] * 2
    texts += texts[:3]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontaminate.find_leaks(docs(spark, texts), bench).collect()
    leaky = [*range(30), 32, 33, 34]
    assert sorted((r.doc_id, r.item_id) for r in found) == [(d, k) for d in leaky for k in range(130)]
    assert all(r.similarity == pytest.approx((2 * 40 - 6) / (2 * 46)) and r.end_word == 60 for r in found)
    assert {r.doc_id for r in decontaminate.drop_leaks(docs(spark, texts), bench).collect()} == {30, 31}


def test_alignments_in_one_pass_are_those_one_by_one():
    rng = np.random.default_rng(45)
    items = [rng.integers(-2, 9, rng.integers(1, 30)) for _ in range(60)]
    windows = [rng.integers(0, 9, rng.integers(1, 60)) for _ in range(60)]
    scores, ends = decontaminate.smith_waterman_many(items, windows)
    for item, window, score, end in zip(items, windows, scores, ends, strict=True):
        table = np.zeros((len(item) + 1, len(window) + 1))
        for i, x in enumerate(item, 1):
            for j, y in enumerate(window, 1):
                table[i, j] = max(0, table[i - 1, j - 1] + (2 if x == y else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
        assert score == table.max()
        assert score == 0 or score == table[:, end].max()


def test_leaks_are_those_of_all_pairs(spark):
    rng = random.Random(25)
    items = [" ".join(rng.choice(WORDS) + rng.choice("xyz") for _ in range(30)) for _ in range(15)]
    items += [" ".join(items[0].split()[:20] + [f"o{k}{j}" for j in range(10)]) for k in range(8)]
    texts = []
    for _ in range(60):
        w = rng.choice(items).split()
        for _ in range(rng.randint(0, 12)):
            how, at = rng.random(), rng.randrange(len(w))
            w[at : at + 1] = [] if how < 0.2 else [w[at], "more"] if how < 0.4 else ["other"]
        texts.append(" ".join([prose(rng, rng.randint(0, 40)), *w, prose(rng, rng.randint(0, 40))]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(docs(spark, texts), bench).collect()}
    want = {}
    for i, t in enumerate(texts):
        for k, x in enumerate(items):
            vocab = {}
            a = np.array([vocab.setdefault(w, len(vocab)) for w in x.split()])
            score, _ = decontaminate.smith_waterman(a, np.array([vocab.get(w, -1) for w in t.split()]))
            if score / (2 * len(a)) >= 0.5:
                want[i, k] = score / (2 * len(a))
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want)
    assert all(s == pytest.approx(want[k]) for k, s in got.items())


def test_leaks_of_odd_rows(spark):
    item = " ".join(f"w{k}" for k in range(30))
    bench = spark.createDataFrame([(1, item), (1, item), (None, item + " tail"), (2, None)], "item_id long, text string").selectExpr("*", "1 as g", "2 as ik")
    long = "x y " * 50_000 + item
    df = docs(spark, [item, item, long, None, item], [5, 5, 6, 7, None]).selectExpr("*", "1 as hits", "2 as th", "'q' as item")
    got = sorted((str(r.doc_id), str(r.item_id)) for r in decontaminate.find_leaks(df, bench).collect())
    assert got == sorted((d, i) for d in ("5", "5", "6", "None") for i in ("1", "None"))
    assert [r.doc_id for r in decontaminate.drop_leaks(df, bench).collect()] == [7]


# --- toxicity ---


def test_toxicity_on_held_out_labels(spark):
    rng = random.Random(6)
    bad = ["vexa", "groxly", "plorm", "snart"]
    texts, toxic = [], []
    for _ in range(400):
        t = rng.random() < 0.3
        w = [rng.choice(WORDS) for _ in range(rng.randint(20, 80))]
        if t:
            for _ in range(rng.randint(2, 6)):
                w[rng.randrange(len(w))] = rng.choice(bad)
        texts.append(" ".join(w))
        toxic.append(int(t))
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1, toxic[i]) for i in range(250)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.score(df, toxicity.fit(df, labels)).collect()}
    held = range(250, 400)
    assert sum(out[i].toxic == bool(toxic[i]) for i in held) >= 0.97 * len(held)
    assert all(0 <= r.severity <= 2 for r in out.values())
    many, few = " ".join(bad), bad[0]
    model = toxicity.fit(df, labels)
    assert model.above(many).sum() > model.above(few).sum() > model.above(None).sum()
    assert all(a >= b for a, b in [model.above(many)])


def test_toxicity_scores_are_those_of_the_weights(spark):
    """Severity, p_toxic and grade of each text against sums over its words and word beginnings."""
    rng = random.Random(31)
    weights = {w: rng.uniform(-3, 3) for w in rng.sample(WORDS, 12)} | {"^" + w[:n]: rng.uniform(-1, 1) for w in rng.sample(WORDS, 12) for n in toxicity.PREFIXES}
    model = toxicity.OrdinalModel(weights, (0.5, 2.0))
    texts = [prose(rng, rng.randint(0, 40)) for _ in range(80)] + [None, ""]
    got = {r.doc_id: r for r in toxicity.score(docs(spark, texts), model).collect()}
    for i, text in enumerate(texts):
        words = set((text or "").split())
        score = sum(weights.get(w, 0) for w in words)
        for f, v in weights.items():
            if f[0] == "^":
                score += v * math.log2(1 + sum(w.startswith(f[1:]) and len(w) > len(f) - 1 for w in words))
        above = [1 / (1 + math.exp(c - score)) for c in (0.5, 2.0)]
        bounds = [1, *above, 0]
        share = [a - b for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        assert got[i].p_toxic == pytest.approx(above[0]) and got[i].severity == pytest.approx(sum(k * p for k, p in enumerate(share)))
        assert got[i].grade == share.index(max(share)) and got[i].toxic == (above[0] >= 0.5)


def test_ordinal_fit_is_where_the_likelihood_is_flat():
    rng = np.random.default_rng(3)
    x = (rng.random((200, 12)) < 0.3) * rng.random((200, 12))
    grade = np.clip(np.rint(x @ rng.normal(0, 2, 12) + rng.logistic(0, 1, 200) * 0.5 + 0.5), 0, 2).astype(int)
    row, col = np.nonzero(x)
    l2 = 0.01
    w, cuts = toxicity._descend(row, col, x[row, col], x.shape, grade, 0.0, l2, 5000, np.array([0.0, 1.0]))

    def objective(w, cuts):
        p = 1 / (1 + np.exp(cuts[None, :] - (x @ w)[:, None]))
        over = grade[:, None] > np.arange(2)[None, :]
        return -np.log(np.where(over, p, 1 - p)).sum(1).mean() + l2 / 2 * (w**2).sum()

    at = np.concatenate([w, cuts])
    for k in range(14):
        step = np.zeros(14)
        step[k] = 1e-5
        slope = (objective(*np.split(at + step, [12])) - objective(*np.split(at - step, [12]))) / 2e-5
        assert abs(slope) < 1e-4


def test_toxicity_of_long_texts_and_repeated_rows(spark):
    bad = ["vexa", "groxly", "plorm"]
    rng = random.Random(26)
    texts = [" ".join([prose(rng, 30), *(bad if k % 3 == 0 else [])]) for k in range(90)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int")
    df = docs(spark, texts + texts[:40] * 3 + [prose(rng, 50_000) + " vexa groxly plorm", None], [*range(90), *[*range(40)] * 3, 500, None])
    once = toxicity.fit(docs(spark, texts), labels)
    model = toxicity.fit(df, labels)
    assert model.weights == pytest.approx(once.weights) and model.thresholds == pytest.approx(once.thresholds)
    rows = toxicity.score(df, model).collect()
    assert len(rows) == 212 and all(len({r.severity for r in rows if r.doc_id == i}) == 1 for i in range(90))
    assert next(r for r in rows if r.doc_id == 500).toxic and not next(r for r in rows if r.doc_id is None).toxic


def test_toxicity_defined_cases(spark):
    df = docs(spark, [None, "", "a b"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.score(df.selectExpr("*", "'x' as grade"), toxicity.fit(df, none)).collect()
    assert [r.toxic for r in rows] == [False] * 3 and all(r.severity < 1e-9 for r in rows)
    assert toxicity.drop_toxic(df.selectExpr("*", "'x' as grade"), toxicity.OrdinalModel()).columns[-1] == "grade"
    assert toxicity.score(empty(spark), toxicity.OrdinalModel()).count() == 0


# --- language-model scoring ---


def test_lm_score_prefers_the_target(spark):
    rng = random.Random(7)
    a, b = WORDS[:30], WORDS[30:]
    texts = [" ".join(rng.choice(a if i % 2 else b) for _ in range(80)) for i in range(120)]
    df = docs(spark, texts + [None, ""])
    target = spark.createDataFrame([(i,) for i in range(1, 60, 2)] + [(None,), (1,)], "doc_id long")
    rows = {r.doc_id: r for r in lm_score.score(df, lm_score.fit(df, target, RANKS), RANKS).collect()}
    assert max(rows[i].score for i in range(61, 120, 2)) < min(rows[i].score for i in range(60, 120, 2))
    assert rows[120].n_tokens == rows[121].n_tokens == 1 and rows[120].score == rows[121].score
    assert all(abs(r.score - (r.target_loss - r.background_loss)) < 1e-12 for r in rows.values())


def test_lm_counts_are_exact(spark):
    texts = ["a b a b", "a c", "a b a b"]
    df = docs(spark, texts)
    m = lm_score.fit(df, df.where("doc_id = 1").select("doc_id"), RANKS)
    enc = packing.encoder(RANKS, {"<|endoftext|>": lm_score.END})
    ids = [lm_score.ids_of(enc, t) for t in texts]
    for c, rows in ((1, ids), (0, ids[1:2])):
        assert m.unigram[c].sum() == m.bigram[c].sum() == sum(len(x) - 1 for x in rows)
        want = np.bincount(np.concatenate([x[1:] for x in rows]), minlength=lm_score.N_IDS)
        assert (m.unigram[c] == want).all()
    assert lm_score.fit(empty(spark), df.select("doc_id"), RANKS).unigram.sum() == 0


def test_lm_scores_are_those_of_exact_bigrams(spark):
    rng = random.Random(17)
    enc = packing.encoder(RANKS, {"<|endoftext|>": lm_score.END})
    texts = [" ".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") + rng.choice("lnrst") for _ in range(400)) for _ in range(60)] + [None, ""]
    ids = [lm_score.ids_of(enc, t) for t in texts]
    good = {*range(0, 60, 3)}
    pairs = [Counter(p for i, x in enumerate(ids) if c or i in good for p in zip(x[:-1].tolist(), x[1:].tolist(), strict=True)) for c in range(2)]
    single = [Counter(), Counter()]
    for one, two in zip(single, pairs, strict=True):
        for (_, v), n in two.items():
            one[v] += n
    assert len(pairs[1]) > 15_000

    total = [sum(x.values()) for x in single]
    scale = [1.0, total[0] / total[1]]
    assert total[1] == sum(len(x) - 1 for x in ids)

    def loss(c, i, u, v, left_out):
        own = ids[i].tolist() if left_out and (c or i in good) else [0]
        two, one = Counter(zip(own[:-1], own[1:], strict=True)), Counter(own[1:])
        p1 = (scale[c] * (single[c][v] - one[v]) + 100 / lm_score.N_IDS) / (scale[c] * (total[c] - len(own) + 1) + 100)
        return -math.log((scale[c] * (pairs[c][u, v] - two[u, v]) + 4 * p1) / (scale[c] * (single[c][u] - one[u]) + 4))

    df, target = docs(spark, texts), spark.createDataFrame([(i,) for i in good], "doc_id long")
    model = lm_score.fit(df, target, RANKS)
    coded = lm_score.code(df, target, RANKS, chunk_ids=1500)
    assert coded.select("chunk").distinct().count() > 8
    for out, left_out in ((lm_score.score(df, model, RANKS), False), (lm_score.score_coded(coded, lm_score.count(coded)), True)):
        rows = {r.doc_id: r for r in out.collect()}
        assert len(rows) == len(texts)
        for i in (0, 1, 2, 59, 60, 61):
            steps = list(zip(ids[i][:-1].tolist(), ids[i][1:].tolist(), strict=True))
            want = [sum(loss(c, i, u, v, left_out) for u, v in steps) / len(steps) for c in range(2)]
            assert rows[i].n_tokens == len(steps)
            assert rows[i].target_loss == pytest.approx(want[0], abs=1e-9) and rows[i].background_loss == pytest.approx(want[1], abs=1e-9)


def test_lm_targets_are_found_by_either_join(spark, monkeypatch):
    rng = random.Random(17)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(40)] + [None]
    df, good = docs(spark, texts, [*range(39), 7, None]), spark.createDataFrame([(k,) for k in (1, 7, 7, 30, None, 99)], "doc_id long")

    def scores():
        coded = lm_score.code(df, good, RANKS)
        return sorted((str(r.doc_id), r.n_tokens, r.score) for r in lm_score.score_coded(coded, lm_score.count(coded)).collect())

    sent = scores()
    monkeypatch.setattr(lm_score, "MAX_SENT", 0)
    assert scores() == sent and len(sent) == 41


def test_lm_losses_of_counts_beyond_32_bits():
    unigram = np.zeros((2, lm_score.N_IDS), np.int64)
    unigram[:, 7] = 2**40
    none = tuple(np.zeros(1, np.int64) for _ in range(4))
    t, b = lm_score.losses(np.array([7 * lm_score.N_IDS + 7]), [np.array([2**39])] * 2, unigram, none, [np.ones(1, np.int64)] * 2)
    assert t[0] == b[0] == pytest.approx(math.log(2))


def test_lm_defined_cases(spark):
    df = docs(spark, [None, "", "a b", "a b", "c " * 30_000], [None, 1, 2, 2, 3]).selectExpr("*", "1 as pair", "2 as target", "3 as chunk")
    coded = lm_score.code(df, df.where("doc_id = 2").select("doc_id"), RANKS)
    rows = lm_score.score_coded(coded, lm_score.count(coded)).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in rows)[-1] == (True, 1) and len(rows) == 5
    assert len({r.score for r in rows if r.doc_id == 2}) == 1 and all(math.isfinite(r.score) for r in rows)
    blank = lm_score.code(empty(spark), None, RANKS)
    assert lm_score.score_coded(blank, lm_score.count(blank)).count() == 0


# --- chat ---


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_roles_are_recovered(spark):
    rng = random.Random(8)
    rows = []
    for c in range(40):
        if c % 3 == 0:
            rows.append((c, 0, "system", "be kind " + prose(rng, 5)))
        for t in range(1, 9):
            user = t % 2 == 1
            rows.append((c, t, "user" if user else "assistant", prose(rng, 8) + "?" if user else prose(rng, 60) + "\n" + prose(rng, 60)))
    blind = [(c, t, r if c < 20 else None, x) for c, t, r, x in rows]
    got = {(r.conv_id, r.turn): r.role for r in chat.parse(turns(spark, blind)).collect()}
    want = {(c, t): r for c, t, r, _ in rows if c >= 20}
    assert sum(got[k] == v for k, v in want.items()) >= 0.95 * len(want)


def test_fragments_give_the_whole_path():
    rng = np.random.default_rng(9)
    m = chat.RoleModel(rng.random(3), rng.random((3, 3)), rng.random((3, 3)), rng.random((3, chat.SYMBOLS)))
    symbols = rng.integers(0, chat.SYMBOLS, 60).tolist()
    score, back = m.start + m.emit[:, symbols[0]], []
    for s in symbols[1:]:
        total = score[:, None] + m.step(s)
        back.append(total.argmax(0))
        score = total.max(0)
    whole = [int(score.argmax())]
    for b in reversed(back):
        whole.append(int(b[whole[-1]]))
    whole = whole[::-1]
    cuts, before, out = [0, 13, 14, 40, 60], 0, []
    for k in range(4):
        part = symbols[cuts[k] : cuts[k + 1]]
        out += m.path(part, k == 0, before, whole[cuts[k + 1] - 1])
        before = out[-1]
    assert out == whole


def brute_roles(model, texts):
    """Viterbi over the lines of one conversation, a line at a time."""
    symbols = [chat.observe(x, k == 0)[0] for t in texts for k, x in enumerate((t or "").split("\n"))]
    score, back = model.start + model.emit[:, symbols[0]], []
    for s in symbols[1:]:
        total = score[:, None] + model.step(s)
        back.append(total.argmax(0))
        score = total.max(0)
    out = [int(score.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return [chat.ROLES[r] for r in out[::-1]]


def test_chat_is_viterbi_however_conversations_are_cut(spark):
    rng = random.Random(18)
    talk = lambda: rng.choice(["", "User: ", "AI: ", "### system\n"]) + "\n".join(prose(rng, rng.choice([0, 2, 9, 40])) + rng.choice(["", "?"]) for _ in range(rng.randint(1, 3)))
    rows = [(c, t, rng.choice([*chat.ROLES, None]), talk()) for c, n in enumerate([1, 2, 70, 9, 3]) for t in range(n)]
    counts = {"start": np.zeros(3), "cont": np.zeros((3, 3)), "turn": np.zeros((3, 3)), "emit": np.zeros((3, chat.SYMBOLS))}
    for c in range(5):
        before = None
        for k, (_, _, role, text) in enumerate(r for r in rows if r[0] == c):
            r = -1 if role is None else chat.ROLES.index(role)
            if r >= 0:
                for j, line in enumerate(text.split("\n")):
                    counts["emit"][r, chat.observe(line, j == 0)[0]] += 1
                    counts["cont"][r, r] += j > 0
                if k == 0:
                    counts["start"][r] += 1
                elif before >= 0:
                    counts["turn"][before, r] += 1
            before = r
    model = chat.RoleModel(**counts)
    want = {c: brute_roles(model, [x for d, _, _, x in rows if d == c]) for c in range(5)}
    for size in (20_000, 7, 1):
        got = {c: [] for c in range(5)}
        for r in sorted(chat.parse(turns(spark, rows), size).collect(), key=lambda r: (r.conv_id, r.turn, r.part)):
            got[r.conv_id] += [r.role] * r.n_lines
        assert got == want


def test_chat_defined_cases(spark):
    rows = [(1, 0, "user", "User: hello?\nAssistant: good day"), (1, 1, None, None), (None, 0, "odd", "x"), (2, 5, "user", "a"), (2, 5, "user", "a")]
    out = chat.parse(turns(spark, rows).selectExpr("*", "1 as conv", "2 as frag")).collect()
    first = sorted(((r.part, r.role, r.text) for r in out if r.conv_id == 1 and r.turn == 0))
    assert first == [(0, "user", "<|user|>\nhello?"), (1, "assistant", "<|assistant|>\ngood day")]
    assert sum(r.conv_id is None for r in out) == 1 and sum(r.conv_id == 2 for r in out) == 2
    assert chat.parse(turns(spark, [])).count() == 0
