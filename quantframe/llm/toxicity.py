"""Toxicity by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight per word shared by all ordered thresholds, and the
expected severity is the sum over k of P(grade > k). x holds which words and word beginnings a text has. Grades come from
the labels: 0 for documents labelled clean; labelled toxic ones are split into 1 and 2 by how many
distinct words typical of toxic documents they hold.

The model is fitted on at most `max_fit` labelled documents (a bound that is a parameter), chosen by a
hash of doc_id with all texts of the sample read whole; scoring reads every whole text.

Defined cases: null or empty text has severity of a text without known words; a null or repeated
label row is left out or counted once; without labels of both kinds nothing is toxic (severity 0).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

_WORD = re.compile(r"[^\W\d_]+")
GRADES = 3
PREFIXES = (3, 4, 5, 6)


def word_set(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features(words: set[str]) -> dict[str, float]:
    """The words, and their beginnings (with a mark that no word has) by the log of how many distinct words share them."""
    counts = Counter("^" + w[:n] for n in PREFIXES for w in words if len(w) > n)
    return dict.fromkeys(words, 1.0) | {f: log2(1 + n) for f, n in counts.items()}


@dataclass
class OrdinalModel:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (30.0, 60.0)

    def __post_init__(self):
        self.begins = {f[1:] for f in self.weights if f[0] == "^"}

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each threshold."""
        weights, words = self.weights, word_set(text)
        score = sum(weights[w] for w in words & weights.keys())
        begun: dict[str, int] = {}
        for n in PREFIXES:
            for w in words:
                if len(w) > n and w[:n] in self.begins:
                    begun["^" + w[:n]] = begun.get("^" + w[:n], 0) + 1
        score += sum(weights[f] * log2(1 + c) for f, c in begun.items())
        return 1.0 / (1.0 + np.exp(np.clip(np.asarray(self.thresholds) - score, -60, 60)))


def _descend(row: np.ndarray, col: np.ndarray, value: np.ndarray, shape: tuple[int, int], grade: np.ndarray, l1: float, l2: float, steps: int, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated proximal gradient on the cumulative-link likelihood: shared weights, one cut a threshold. Entries come by row."""
    n, width = shape
    by_col = np.argsort(col, kind="stable")
    rows_of, values_of = row[by_col], value[by_col]
    del by_col
    in_row, in_col = np.bincount(row, minlength=n), np.bincount(col, minlength=width)
    row_at, col_at, empty_row, empty_col = np.cumsum(in_row) - in_row, np.cumsum(in_col) - in_col, in_row == 0, in_col == 0

    def sums(x: np.ndarray, at: np.ndarray, empty: np.ndarray) -> np.ndarray:
        out = np.add.reduceat(np.append(x, 0.0), at)
        out[empty] = 0.0
        return out

    times = lambda w: sums(value * w[col], row_at, empty_row)
    back = lambda z: sums(values_of * z[rows_of], col_at, empty_col)
    w, x, momentum, v = np.zeros(width), np.zeros(width), 1.0, np.ones(width)
    for _ in range(15):  # the largest eigenvalue bounds the step
        v = back(times(v))
        v /= (top := float(np.linalg.norm(v)))
    rate = 1.0 / (0.25 * (GRADES - 1) * top / n + l2)
    for _ in range(steps):
        z = times(x)
        p = 1.0 / (1.0 + np.exp(np.clip(cuts[None, :] - z[:, None], -40, 40)))
        err = p - (grade[:, None] > np.arange(GRADES - 1)[None, :])
        g = back(err.sum(1)) / n + l2 * x
        new = x - rate * g
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        if (new - w) @ (x - new) > 0:  # restart where momentum turns against the descent
            momentum = 1.0
        m = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        x, w, momentum = new + (momentum - 1) / m * (new - w), new, m
        cuts = np.maximum.accumulate(cuts + 2.0 * err.mean(0))
    return w, cuts


def fit_ordinal(row: np.ndarray, col: np.ndarray, value: np.ndarray, names: list[str], grade: np.ndarray, l1: float = 1.5e-3, l2: float = 2e-4, steps: int = 150) -> OrdinalModel:
    """Model of features given as (document, feature, value). An L1 fit chooses the features; a second fit over those alone gives their weights unshrunk."""
    if not len(row):
        return OrdinalModel()
    share = [np.clip(np.mean(grade > k), 1e-3, 1 - 1e-3) for k in range(GRADES - 1)]
    cuts = np.maximum.accumulate(np.array([-np.log(s / (1 - s)) for s in share]) + 1e-6 * np.arange(GRADES - 1))
    w, cuts = _descend(row, col, value, (len(grade), len(names)), grade, l1, 0.0, steps, cuts)
    chosen = np.flatnonzero(w)
    if not len(chosen):
        return OrdinalModel()
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    on = place[col] >= 0
    w, cuts = _descend(row[on], place[col[on]], value[on], (len(grade), len(chosen)), grade, 0.0, l2, 3 * steps, cuts)
    return OrdinalModel({names[k]: float(v) for k, v in zip(chosen, w, strict=True)}, tuple(map(float, cuts)))


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [features(word_set(text)) for text in batch["text"]]
        out = batch[["doc", "toxic"]].assign(f=pd.Series([list(x) for x in found], batch.index, dtype=object))
        yield out.assign(x=pd.Series([np.fromiter(x.values(), np.float32, len(x)) for x in found], batch.index, dtype=object))


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = 3000, min_docs: int = 4, many: int = 3) -> OrdinalModel:
    """Model of at most `max_fit` labelled documents (of rows that share a doc_id the least text counts).

    Features are counted by Spark; only those that are used, and their numbers in each document, come to the driver. A
    document has grade 0 if it is labelled clean, 1 if toxic, 2 if toxic with `many` or more distinct words that are
    typical of toxic documents.
    """
    small_batches(docs.sparkSession)
    sample = (
        labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("__qf_toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit)
        .select(F.col("doc_id").alias("__qf_label"), "__qf_toxic")
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__qf_label"))
    texts = texts.groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max("__qf_toxic").cast("int").alias("toxic"), F.min("text").alias("text"))
    # the sample is small: one part of it for each core, not one for each Arrow batch
    texts = texts.repartition(docs.sparkSession.sparkContext.defaultParallelism, "doc")
    found = materialize(texts.mapInPandas(_featured, "doc long, toxic int, f array<string>, x array<float>"), "toxic-features")
    n, n1 = found.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n1 or n1 == n:
        return OrdinalModel()
    typical = (F.substring("f", 1, 1) != "^") & (F.col("t") >= 3) & ((F.col("t") + 0.5) / n1 > 8 * (F.col("n") - F.col("t") + 0.5) / (n - n1))
    used = (F.col("n") >= min_docs) & (F.col("n") <= n / 3)
    seen = found.select("toxic", F.explode("f").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t"))
    vocab = seen.where(typical | used).select("f", typical.alias("typical"), used.alias("used")).toPandas().sort_values("f")
    names, is_typical, is_used = vocab["f"].tolist(), vocab["typical"].to_numpy(), vocab["used"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast({f: k for k, f in enumerate(names)})

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cols = [np.array([shared.value.get(f, -1) for f in x], np.int32) for x in batch["f"]]
            out = batch[["doc", "toxic"]].assign(cols=pd.Series([c[c >= 0] for c in cols], batch.index, dtype=object))
            yield out.assign(x=pd.Series([x[c >= 0] for c, x in zip(cols, batch["x"], strict=True)], batch.index, dtype=object))

    rows = found.mapInPandas(numbered, "doc long, toxic int, cols array<int>, x array<float>").toPandas().sort_values("doc")
    row, col = np.repeat(np.arange(n, dtype=np.int32), rows["cols"].map(len)), np.concatenate(rows["cols"].tolist()).astype(np.int32)
    value, toxic = np.concatenate(rows["x"].tolist()), rows["toxic"].to_numpy()
    del rows, vocab
    grade = toxic * (1 + (np.bincount(row, is_typical[col], n) >= many))
    on = is_used[col]
    row, col, value = row[on], col[on], value[on]
    return fit_ordinal(row, col, value, names, grade)


def scored(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """docs plus the struct __qf_tox of severity (expected grade, 0 to 2), p_toxic and grade (most likely)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            p = np.array([m.above(x) for x in texts]).reshape(len(texts), -1)
            bounds = np.hstack([np.ones((len(p), 1)), p, np.zeros((len(p), 1))])
            yield pd.DataFrame({"severity": p.sum(1), "p_toxic": p[:, 0], "grade": (bounds[:, :-1] - bounds[:, 1:]).argmax(1)})

    return docs.withColumn("__qf_tox", F.pandas_udf(run, "severity double, p_toxic double, grade int")("text"))


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """docs with severity, p_toxic, grade and toxic (p_toxic >= 0.5), which replace columns so named."""
    made = {"severity": F.col("__qf_tox.severity"), "p_toxic": F.col("__qf_tox.p_toxic"), "grade": F.col("__qf_tox.grade"), "toxic": F.col("__qf_tox.p_toxic") >= 0.5}
    return scored(docs, model).select(*[F.col(f"`{c}`") for c in docs.columns if c not in made], *[v.alias(k) for k, v in made.items()])


def drop_toxic(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of docs that are not toxic, with the columns of docs alone."""
    return scored(docs, model).where(F.col("__qf_tox.p_toxic") < 0.5).drop("__qf_tox")
