"""The pipeline and its stages against plain versions on a small corpus."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quantframe.llm import decontaminate, stages, toxicity

from .support import SCHEMA, WORDS, docs, empty, odd_texts, prose
from .test_line_dedup import brute as brute_lines
from .test_minhash import brute as brute_near

BAD = ["vexa", "groxly", "plorm", "snart"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of every kind, labels of some and a benchmark, as files."""
    rng = random.Random(31)
    items = [" ".join(rng.choice(WORDS) + rng.choice("qxz") for _ in range(30)) for _ in range(6)]
    line = "a licence line that many documents share"
    texts = []
    for k in range(240):
        w = prose(rng, rng.randint(30, 120)).split()
        if k % 4 == 0:
            for _ in range(5):
                w[rng.randrange(len(w))] = rng.choice(BAD)
        texts.append("\n".join([" ".join(w), *[line] * (k % 5 == 1)]))
    clean = [t for t in texts if not set(t.split()) & set(BAD)]
    texts += [t + " tail" for t in clean[:15]] + clean[15:25] + [prose(rng, 20) + " " + x + " " + prose(rng, 20) for x in items] + odd_texts(rng)
    path = str(tmp_path_factory.mktemp("corpus"))
    ids = list(range(len(texts) - 2)) + [None, 3]
    labels = [(i, 1, int(bool(set((t or "").split()) & set(BAD)))) for i, t in enumerate(texts[:240]) if i % 3]
    docs(spark, texts, ids).write.parquet(path + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(path + "/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(path + "/benchmark.parquet")
    return path, items


def key(r):
    return (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=key)


def brute_stage(name, spark, given, folder):
    path, items = folder
    if name == "toxicity":
        model = toxicity.fit(spark.createDataFrame([(i, t) for i, t in given], "doc_id long, text string"), spark.read.parquet(path + "/labels.parquet"))
        return [(i, t) for i, t in given if model.above(t)[0] < 0.5]
    if name == "line_dedup":
        out = brute_lines([(-(2**63) if i is None else i, t) for i, t in given])
        return [(None if i == -(2**63) else i, t) for i, _, _, t in out]
    if name == "near_dedup":
        named = [(i, t) for i, t in given if i is not None]
        found = brute_near([(k, t) for k, (_, t) in enumerate(sorted(named, key=key))], 5, 80)
        order = sorted(named, key=key)
        # rows that share a doc_id are one document
        first = {}
        for k, (i, _) in enumerate(order):
            first.setdefault(i, []).append(found[k][1])
        return [(i, t) for i, t in given if i is None or any(order[c][0] == i for c in first[i])]
    words = [decontaminate.words_of(x) for x in items]

    def leaks(text):
        for w in words:
            vocab = {}
            a = np.array([vocab.setdefault(x, len(vocab)) for x in w])
            score, _ = decontaminate.smith_waterman(a, np.array([vocab.get(x, -1) for x in decontaminate.words_of(text)], np.int64))
            if score / (2 * len(a)) >= 0.5:
                return True
        return False

    return [(i, t) for i, t in given if not leaks(t)]


def test_each_stage_is_its_plain_version_on_what_came_before(spark, folder):
    path, _ = folder
    now = spark.read.parquet(path + "/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, now, path)
        assert made.columns == now.columns
        given, made = rows(now), spark.createDataFrame(made.collect(), SCHEMA)
        want = brute_stage(name, spark, given, folder)
        assert rows(made) == sorted(want, key=key), name
        assert 0 < made.count() <= now.count()
        now = made
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = stages.pack(spark, now, path).collect()
    want = sorted((-1 if i is None else i, len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows(now))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.doc_tokens) for r in pieces if r.start == 0) == want
    run = corpus_pipeline.run(spark, path).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.doc_tokens) for r in run if r.start == 0) == want  # where documents are cut follows partitions
    assert sum(r.length for r in run) == sum(n for _, n in want)
    assert all(r.ids_crc32 == zlib.crc32(np.array([0], "<u4")) for r in run if r.doc_tokens == 1)


def test_stages_on_empty_tables_and_clashing_names(spark, folder):
    path, _ = folder
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), path).count() == 0
    now = spark.read.parquet(path + "/documents.parquet").limit(30).selectExpr("*", "1 as id", "2 as th", "3 as n_lines", "4 as grade", "5 as item_id", "6 as `a.b`", "7 as hits")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, now, path)
        assert made.columns == now.columns and {tuple(r)[-7:] for r in made.collect()} == {(1, 2, 3, 4, 5, 6, 7)}
