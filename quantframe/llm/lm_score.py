"""Language-model scoring by cross-entropy difference.

Two bigram models, of a target corpus and of all documents (background), share one vocabulary: the ids of a
public byte-level BPE. Counts cover every token of every document and are exact; the counts of bigrams are a
table that grows with the corpus and never goes to the driver or whole to a task (only counts of single ids
do, which the vocabulary bounds). Tasks code texts as ids in chunks of about `chunk_ids` ids and list the
bigrams of each chunk once; that list is summed up over chunks for the counts and joined to them for the
scores, so a bigram has at most one row a chunk, however common it is.

The models are matched: of one order, one smoothing and one weight. Background counts are scaled to the number of
tokens of the target corpus, so that equal prior weights (PRIOR bigrams, BASE single ids) mean the same in both:
P1(v) = (s n(v) + BASE / vocabulary) / (s n + BASE) and P(v | u) = (s n(u v) + PRIOR P1(v)) / (s n(u) + PRIOR). A
document that the counts hold is scored without its own counts, in both models, so no text speaks for itself. A
document's score is its mean loss a token under the target model minus that under the background model: the lower,
the more it is like the target.

Defined cases: each text starts and ends with the end id, so null and empty texts have one token; repeated
rows count and are scored as often as they occur; without target documents the target model is
uniform; other columns are left out, a null doc_id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .packing import encoder

N_IDS = 50_257
END = N_IDS - 1
PRIOR, BASE = 4.0, 100.0
_CODED = "chunk long, doc_id long, ids binary, pair long, target long, every long"
_SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def ids_of(enc, text: str | None) -> np.ndarray:
    ids = enc.encode_to_numpy(text or "", allowed_special="all").astype(np.int64)
    return np.concatenate([[END], ids, [END]])


def pairs_of(ids: np.ndarray) -> np.ndarray:
    return ids[:-1] * N_IDS + ids[1:]


@dataclass
class Model:
    unigram: np.ndarray  # by corpus (target, background) and id
    pairs: DataFrame  # pair (u * N_IDS + v), target, every: one row for each bigram of the corpus

    @property
    def bigram(self) -> np.ndarray:
        """Counts by corpus and row of the table; brings the table to the driver, so for small ones only."""
        found = self.pairs.toPandas()
        return np.stack([found["target"].to_numpy(np.int64), found["every"].to_numpy(np.int64)])


def scales(unigram: np.ndarray) -> tuple[float, float]:
    """Weight of a count in the target and in the background model."""
    target, every = (int(x.sum()) for x in unigram)
    return 1.0, target / every if target and every else 1.0


def losses(pair: np.ndarray, counts: list[np.ndarray], unigram: np.ndarray, own: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], held: list[np.ndarray]) -> list[np.ndarray]:
    """Negative log-likelihood of bigrams under target and background.

    own: the document's counts of the bigram, of its first id, of its second id and of all; held: by corpus, whether
    its counts hold the document (1) or not (0).
    """
    u, v, out = pair // N_IDS, pair % N_IDS, []
    for n, one, in_, s in zip(counts, unigram, held, scales(unigram), strict=True):
        both, first, second, every = (x * in_ for x in own)
        single = (s * (one[v] - second) + BASE / N_IDS) / (s * (int(one.sum()) - every) + BASE)
        out.append(-np.log((s * (n - both) + PRIOR * single) / (s * (one[u] - first) + PRIOR)))
    return out


def _code(path: str, chunk_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, k = encoder(path, {"<|endoftext|>": END}), TaskContext.get().partitionId(), 0
        names = ["chunk", "doc_id", "ids", "pair", "target", "every"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        held: list[np.ndarray] = []
        wanted: list[np.ndarray] = []
        size = 0

        def rows(n: int, **given) -> pa.RecordBatch:
            chunk = pa.array(np.full(n, (part << 32) + k))
            return pa.RecordBatch.from_arrays([chunk if x == "chunk" else given[x] if x in given else pa.nulls(n, t) for x, t in zip(names, kinds, strict=True)], names=names)

        def listed() -> Iterator[pa.RecordBatch]:
            pair, every = np.unique(np.concatenate(held), return_counts=True)
            target = np.zeros(len(pair), np.int64)
            if wanted:
                found, n = np.unique(np.concatenate(wanted), return_counts=True)
                target[np.searchsorted(pair, found)] = n
            for at in range(0, len(pair), 100_000):
                s = slice(at, at + 100_000)
                yield rows(len(pair[s]), pair=pa.array(pair[s]), target=pa.array(target[s]), every=pa.array(every[s].astype(np.int64)))

        for batch in batches:
            keys, goods = batch.column("doc_id"), batch.column("target").to_pylist()
            coded: list[bytes] = []
            at = 0
            for text, good in zip(batch.column("text").to_pylist(), goods, strict=True):
                ids = ids_of(enc, text)
                coded.append(ids.astype("<u2").tobytes())
                pair = pairs_of(ids)
                held.append(pair)
                if good:
                    wanted.append(pair)
                size += len(pair)
                if size >= chunk_ids:
                    yield rows(len(coded), doc_id=keys.slice(at, len(coded)), ids=pa.array(coded, pa.binary()), target=pa.array(goods[at : at + len(coded)]).cast(pa.int64()))
                    yield from listed()
                    at, coded, held, wanted, size, k = at + len(coded), [], [], [], 0, k + 1
            if coded:
                yield rows(len(coded), doc_id=keys.slice(at, len(coded)), ids=pa.array(coded, pa.binary()), target=pa.array(goods[at:]).cast(pa.int64()))
        if held:
            yield from listed()

    return run


MAX_SENT = 1_000_000  # ids of target documents that may be broadcast (16 bytes each)


def code(docs: DataFrame, target: DataFrame | None, rank_file: str, chunk_ids: int = 1 << 21) -> DataFrame:
    """A table of two kinds of rows: documents as ids, and for each chunk of documents its bigrams with their counts there."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(False).alias("target"))
    if target is not None:
        named = target.select(F.col("doc_id").alias("__qf_id")).where("__qf_id is not null").distinct().withColumn("__qf_in", F.lit(True))
        named = materialize(named, "lm-targets")
        # ids are sent to the texts while there are few of them; only beyond that texts are shuffled to meet them
        named = F.broadcast(named) if named.count() <= MAX_SENT else named.hint("merge")
        rows = rows.join(named, rows["doc_id"] == named["__qf_id"], "left").select("doc_id", "text", F.coalesce("__qf_in", F.lit(False)).alias("target"))
    # a chunk's number holds for one run of a task only, so what was coded is kept as a table
    return materialize(rows.mapInArrow(_code(rank_file, chunk_ids), _CODED), "lm-coded")


def count(coded: DataFrame) -> Model:
    """Model of coded documents."""
    found = coded.where("pair is not null").groupBy("pair").agg(F.sum("target").alias("target"), F.sum("every").alias("every"))
    pairs = materialize(found, "lm-pairs")
    single = pairs.groupBy(F.expr(f"cast(pair % {N_IDS} as int)").alias("id")).agg(F.sum("target").alias("target"), F.sum("every").alias("every")).toPandas()
    unigram = np.zeros((2, N_IDS), np.int64)
    unigram[0, single["id"]] = single["target"]
    unigram[1, single["id"]] = single["every"]
    return Model(unigram, pairs)


def fit(docs: DataFrame, target: DataFrame, rank_file: str) -> Model:
    """Model of docs; target (doc_id) names the documents of the target corpus."""
    return count(code(docs, target, rank_file))


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.concatenate([first, [len(keys)]]))


def score_coded(coded: DataFrame, model: Model, counted: bool = True) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score; counted: the model's counts hold these documents."""
    shared = coded.sparkSession.sparkContext.broadcast(model.unigram)

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        pair = known.column("pair").to_numpy()
        order = np.argsort(pair)
        pair, counts = pair[order], [known.column(x).to_numpy()[order] for x in ("n_target", "n_every")]
        good, raws = texts.column("good").to_numpy(), texts.column("ids").to_pylist()
        n, means = [], []
        at = 0
        while at < len(raws):  # documents of about 250,000 ids at once
            end, size = at, 0
            while end < len(raws) and (end == at or size + len(raws[end]) <= 1 << 21):
                size += len(raws[end])
                end += 1
            some = [pairs_of(np.frombuffer(raw, "<u2").astype(np.int64)) for raw in raws[at:end]]
            sizes = np.array([len(x) for x in some])
            doc, every = np.repeat(np.arange(len(some)), sizes), np.concatenate(some)
            place = np.searchsorted(pair, every)
            kinds, times = _places(doc * len(pair) + place)
            doc, place = np.divmod(kinds, len(pair))
            one, single = _places(np.repeat(np.arange(len(some)), sizes) * N_IDS + every % N_IDS)
            # every id of a text but the end id at its ends is once first and once second of a bigram, and so is that one
            own = (times, single[np.searchsorted(one, doc * N_IDS + pair[place] // N_IDS)], single[np.searchsorted(one, doc * N_IDS + pair[place] % N_IDS)], sizes[doc])
            held = [good[at:end][doc] * int(counted), np.full(len(doc), int(counted))]
            found = losses(pair[place], [x[place] for x in counts], shared.value, own, held)
            n.append(sizes)
            means.append(np.stack([np.bincount(doc, x * times, len(some)) / sizes for x in found]))
            at = end
        t, b = np.concatenate(means, 1) if means else np.empty((2, 0))
        sizes = np.concatenate(n).astype(np.int64) if n else np.empty(0, np.int64)
        return pa.table({"doc_id": texts.column("doc_id"), "n_tokens": sizes, "target_loss": t, "background_loss": b, "score": t - b})

    texts = coded.where("ids is not null").select(F.col("chunk").alias("__chunk"), "doc_id", "ids", F.coalesce("target", F.lit(0)).alias("good"))
    asked = coded.where("pair is not null").select("chunk", "pair")
    counts = model.pairs.select(F.col("pair").alias("__pair"), F.col("target").alias("__t"), F.col("every").alias("__e"))
    # one plan at every size: the counts grow with the corpus
    known = asked.join(counts.hint("merge"), asked["pair"] == counts["__pair"], "left").select("chunk", "pair", F.coalesce("__t", F.lit(0)).alias("n_target"), F.coalesce("__e", F.lit(0)).alias("n_every"))
    return texts.groupBy("__chunk").cogroup(known.groupBy("chunk")).applyInArrow(run, _SCORES)


def score(docs: DataFrame, model: Model, rank_file: str) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of documents that the model's counts do not hold."""
    return score_coded(code(docs, None, rank_file), model, counted=False)
