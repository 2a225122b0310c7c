"""Benchmark decontamination: rare n-gram seeds join documents to items, then Smith-Waterman alignment.

1. Seeds of an item are its word n-grams that at most `rare` items of the whole benchmark hold. Where a stretch of n
   successive n-grams has none so rare, the least common one of the stretch is a seed, so a benchmark of items that
   are alike keeps seeds over the whole length of each item: every rare n-gram and every run of 3 n - 2 words that a
   document copies holds one.
2. Documents are read once. A Bloom filter of all seeds, of at most `filter_bits` bits, goes to the tasks; a document
   with a word n-gram in it is kept with its hits. Hits are joined to the seeds by a shuffle, which drops what
   the filter let through wrongly, and give the pairs of text and item. Equal texts are one text, and rows of a
   seed, an item or a text that many share are dealt to several tasks.
3. A text goes to Python once for AT_ONCE of its items. The words around the common n-grams of a pair are aligned with the item; the pair counts if the score reaches
   `similarity` of the item's full score. A pair is left unaligned only where it can't reach that: each matched word
   adds MATCH and nothing else adds, so `similarity` of the item's words must occur in the document, and in
   the words around the seed.

Words: A-Z lower-cased, ASCII punctuation and white space part them. Items with fewer words than a seed are
not searched: they are too short to tell a copy from chance. Null or empty texts match nothing; repeated
documents each give their pairs, repeated items give them once; a null doc_id or item_id is carried as null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_split, materialize, mix64, small_batches

_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in _SPACED)
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0
PROBES = 4
AT_ONCE = 64  # items handed to Python with one copy of a text
CELLS = 20_000  # window places aligned in one pass
FIRST = 8  # windows in one pass where one copy is enough


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def smith_waterman_many(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each item and its window: best local alignment score and the window position where it ends; ids below 0 match nothing.

    Shorter items and windows are filled up with ids that match nothing, which can't raise a score.
    """
    deep, wide = max(map(len, items), default=0), max(map(len, windows), default=0)
    rows, cols = np.full((len(items), deep), -2), np.full((len(items), wide), -1)
    for k, (item, window) in enumerate(zip(items, windows, strict=True)):
        rows[k, : len(item)] = np.where(item < 0, -2, item)
        cols[k, : len(window)] = window
    steps = -GAP * np.arange(wide + 1)
    row = np.zeros((len(items), wide + 1))
    best, end, each = np.zeros(len(items)), np.zeros(len(items), np.int64), np.arange(len(items))
    for k in range(deep):
        new = np.zeros((len(items), wide + 1))
        np.maximum(row[:, :-1] + np.where(cols == rows[:, k : k + 1], MATCH, MISMATCH), row[:, 1:] + GAP, out=new[:, 1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + steps, axis=1) - steps
        at = row.argmax(1)
        more = row[each, at] > best
        best, end = np.where(more, row[each, at], best), np.where(more, at, end)
    return best, end


def smith_waterman(item: np.ndarray, window: np.ndarray) -> tuple[float, int]:
    """Score and end of one item in one window."""
    best, end = smith_waterman_many([item], [window])
    return float(best[0]), int(end[0])


def gram_hashes(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place."""
    m = max(0, len(word_hash) - n + 1)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = mix64(out + word_hash[k : k + m])
    return out


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def filter_places(grams: np.ndarray, bits: int) -> np.ndarray:
    """The PROBES places of each n-gram in a filter of `bits` (a power of two)."""
    step = mix64(grams) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (grams + np.arange(PROBES, dtype=np.uint64)[:, None] * step) & np.uint64(bits - 1)


def _item_grams(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grams = [gram_hashes(word_hashes(words_of(x)), n).view(np.int64) for x in batch["text"]]
            sizes = [len(g) for g in grams]
            yield pd.DataFrame({"ik": np.repeat(batch["ik"].to_numpy(), sizes), "pos": np.concatenate([np.arange(k) for k in sizes] or [np.empty(0, int)]), "g": np.concatenate(grams or [np.empty(0, np.int64)])})

    return run


def seeds_of(items: DataFrame, n: int, rare: int) -> DataFrame:
    """(g, ik): the seeds of each item (ik its key), as a table."""
    grams = materialize(items.mapInPandas(_item_grams(n), "ik long, pos long, g long"), "item-grams")
    held = grams.select("g", "ik").distinct().groupBy("g").agg(F.count("ik").alias("c")).withColumnRenamed("g", "k")
    counted = grams.join(held, grams["g"] == held["k"]).select("ik", "g", "c", F.floor(F.col("pos") / n).alias("stretch"))
    least = F.min(F.struct("c", "g")).over(Window.partitionBy("ik", "stretch"))
    return materialize(counted.withColumn("least", least).where((F.col("c") <= rare) | (F.struct("c", "g") == F.col("least"))).select("g", "ik").distinct(), "seeds")


def seed_filter(seeds: DataFrame, filter_bits: int) -> tuple[np.ndarray, int]:
    """Bloom filter over the seeds: packed bits and their number, 64 for each seed up to `filter_bits`. Tasks make it piece by piece."""
    grams = seeds.select("g").distinct()
    bits = min(filter_bits, 1 << max(16, (64 * grams.count() - 1).bit_length()))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"at": np.unique(filter_places(batch["g"].to_numpy().view(np.uint64), bits)).astype(np.int64)})

    def piece(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(1 << 16, np.uint8)
        on[rows["at"].to_numpy() & 0xFFFF] = 1
        return pd.DataFrame({"piece": [key[0]], "bits": [np.packbits(on).tobytes()]})

    found = grams.mapInPandas(places, "at long").distinct().groupBy(F.shiftright("at", 16).alias("piece")).applyInPandas(piece, "piece long, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for k, raw in found.collect():
        out[k << 13 : (k + 1) << 13] = np.frombuffer(raw, np.uint8)
    return out, bits


def _hits(shared, bits: int, n: int, words_at_once: int = 500_000):
    def found(texts: list[list[bytes]]) -> list[np.ndarray]:
        sizes = np.array([len(x) for x in texts])
        grams = gram_hashes(word_hashes([w for x in texts for w in x]), n)
        ends = np.cumsum(sizes)
        at = np.arange(len(grams))
        for place in range(PROBES):
            p = filter_places(grams[at], bits)[place].astype(np.int64) if place else (grams & np.uint64(bits - 1)).astype(np.int64)
            at = at[(shared.value[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1]
        owner = np.searchsorted(ends, at, "right")
        inside = at + n <= ends[owner]
        at, owner = at[inside], owner[inside]
        out = [np.empty(0, np.int64)] * len(texts)
        if len(at):
            cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True):
                out[owner[a]] = np.unique(grams[at[a:b]]).view(np.int64)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits, held, size = [], [], 0
            for text in batch["text"]:
                held.append(words_of(text))
                size += len(held[-1])
                if size >= words_at_once:
                    hits += found(held)
                    held, size = [], 0
            hits += found(held) if held else []
            some = np.array([len(x) > 0 for x in hits], bool)
            out = batch.loc[some].astype({"doc_id": "Int64"})
            yield out.assign(hits=pd.Series([x for x in hits if len(x)], out.index, dtype=object))

    return run


def align(words: list[bytes], items: list[list[bytes]], similarity: float, n: int, first: bool = False) -> list[tuple[float, int, int] | None]:
    """For each item: similarity, first word and end word of its best copy among words, if it reaches `similarity`.

    All items share one table of the words' n-grams, and windows of like length are aligned in one pass. With
    `first` items after one that is found are left out (None).
    """
    out: list[tuple[float, int, int] | None] = [None] * len(items)
    if len(words) < n:
        return out
    vocab: dict[bytes, int] = {}
    ids = np.fromiter((vocab.setdefault(w, len(vocab)) for w in words), np.int64, len(words))
    grams = gram_hashes(ids.astype(np.uint64), n)
    order = np.argsort(grams, kind="stable")
    sorted_grams = grams[order]
    held = np.zeros(len(vocab), bool)
    windows: list[tuple[int, int, int]] = []
    wanted = [np.fromiter(map(vocab.get, item, repeat(-2)), np.int64, len(item)) for item in items]
    for k, want in enumerate(wanted):
        least = similarity * len(want) - 1e-9
        inside = want[want >= 0]
        if len(inside) < least or len(want) < n:
            continue
        absent = np.concatenate([[0], np.cumsum(want < 0)])
        at = np.flatnonzero(absent[n:] == absent[:-n])  # n-grams whose words all occur
        own = gram_hashes(np.maximum(want, 0).astype(np.uint64), n)[at]
        lo, hi = np.searchsorted(sorted_grams, own), np.searchsorted(sorted_grams, own, "right")
        times = hi - lo
        starts = order[np.arange(times.sum()) + np.repeat(lo - (np.cumsum(times) - times), times)]
        pad = 8 + len(want) // 4
        spans: list[list[int]] = []
        for b in np.sort(starts - np.repeat(at, times)).tolist():
            begin, end = max(0, b - pad), min(len(ids), b + len(want) + pad)
            if spans and begin <= spans[-1][1] and end - spans[-1][0] <= 4 * len(want) + 64:
                spans[-1][1] = max(spans[-1][1], end)
            else:
                spans.append([begin, end])
        for begin, end in spans:
            held[ids[begin:end]] = True
            if held[inside].sum() >= least:
                windows.append((k, begin, end))
            held[ids[begin:end]] = False
    windows.sort(key=lambda w: (len(wanted[w[0]]), w[2] - w[1]))
    at = 0
    while at < len(windows) and not (first and any(out)):
        end, wide = at, 0
        while end < len(windows) and (wide := max(wide, windows[end][2] - windows[end][1])) * (end - at) < CELLS and not (first and end - at >= FIRST):
            end += 1
        part = windows[at : max(end, at + 1)]
        scores, stops = smith_waterman_many([wanted[k] for k, _, _ in part], [ids[x:y] for _, x, y in part])
        for (k, begin, _), score, stop in zip(part, scores.tolist(), stops.tolist(), strict=True):
            got = (score / (MATCH * len(wanted[k])), begin, begin + stop)
            if got[0] >= similarity:
                out[k] = max(out[k] or got, got)
        at += len(part)
    return out


def _align(similarity: float, n: int, first: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, words, done = None, [], False
        for batch in batches:
            out = []
            for tk, text, items in zip(batch["tk"], batch["text"], batch["items"], strict=True):
                if key != tk:  # parts of a document's items come one after another
                    key, words, done = tk, words_of(text), False
                if first and done:
                    continue
                for x, found in zip(items, align(words, [words_of(x["item"]) for x in items], similarity, n, first), strict=True):
                    if found:
                        done = True
                        out.append((tk, None if pd.isna(x["item_id"]) else int(x["item_id"]), *found))
            frame = pd.DataFrame(out, columns=["tk", "item_id", "similarity", "first_word", "end_word"])
            yield frame.astype({"item_id": "Int64", "similarity": "float64", "first_word": "int64", "end_word": "int64"})

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 4, similarity: float = 0.5, rare: int = 4, filter_bits: int = 1 << 29, first: bool = False) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, similarity, first_word, end_word, and th (hash of the document's text).

    With `first` a document that holds an item need not be given with all of them, only with one at least.
    """
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item")).where("item is not null").distinct()
    items = materialize(items.withColumn("ik", F.xxhash64("item_id", "item")), "items")
    seeds = seeds_of(items.select("ik", F.col("item").alias("text")), n, rare)
    packed, bits = seed_filter(seeds, filter_bits)
    shared = docs.sparkSession.sparkContext.broadcast(packed)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    touched = materialize(base.mapInPandas(_hits(shared, bits, n), "doc_id long, th long, text string, hits array<long>").withColumn("tk", F.md5("text")), "touched")
    asked = materialize(touched.select("tk", F.explode("hits").alias("h")).distinct(), "asked")
    pairs = materialize(join_split(asked, "h", seeds, "g").select("tk", "ik").distinct(), "pairs")
    held = join_split(pairs, "ik", items.withColumnRenamed("ik", "k"), "k").select("tk", "ik", F.struct("item_id", "item").alias("x"))
    nth = F.row_number().over(Window.partitionBy("tk").orderBy("ik"))
    parts = held.withColumn("part", F.floor((nth - 1) / AT_ONCE)).groupBy("tk", "part").agg(F.collect_list("x").alias("items"))
    texts = touched.select(F.col("tk").alias("k"), "text").dropDuplicates(["k"])
    found = parts.join(texts, F.col("tk") == F.col("k")).select("tk", "text", "items").mapInPandas(_align(similarity, n, first), "tk string, item_id long, similarity double, first_word long, end_word long")
    rows = touched.select("doc_id", "th", F.col("tk").alias("dk"))
    return join_split(rows, "dk", found, "tk").select("doc_id", "th", "item_id", "similarity", "first_word", "end_word")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item."""
    leaks = find_leaks(docs, benchmark, first=True).select(F.col("doc_id").alias("__qf_id"), F.col("th").alias("__qf_th")).distinct()
    rows = docs.withColumn("__qf_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    clean = rows.join(leaks, rows["doc_id"].cast("long").eqNullSafe(leaks["__qf_id"]) & (rows["__qf_hash"] == leaks["__qf_th"]), "left_anti")
    return clean.drop("__qf_hash")
