"""Line dedup over a sharded minimal perfect hash.

Lines are hashed once. The distinct line hashes go, shard by shard, into a minimal perfect hash (a cascade of bit
arrays) that indexes three plain arrays: fingerprint, document count and last document. Counts reach a shard as
partial sums (a line by groups of documents), which are added up in the count array at the line's slot. A shard is one
binary row. Documents send the hashes of their lines, never the lines, to the shards and probe the arrays there,
which say whether a line is in enough documents and whether this is the last of them. A shard is copied to as many
tasks as its own probes need (it is compact, and how many they are follows from the counts), and they are dealt to the
copies by document and place, so the probes of one hot line lie over many tasks.

Defined cases: null and empty text are one empty line; a null doc_id counts as one document, smaller
than all others; rows that share doc_id count as one document; other columns pass through. Two lines with equal
64-bit hashes but other fingerprints are both kept: what finds its slot taken is listed beside the arrays.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, small_batches

_WHITE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAMMA = 2.0
PARTS = 8  # partial counts a line may have
MAX_SENT = 100_000  # shards whose numbers of copies may be broadcast


def build_mph(keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Cascade of (size, packed bits) for distinct uint64 keys: a key rests at the first level where no other key shares its bit."""
    levels = []
    while len(keys):
        size = max(64, int(_GAMMA * len(keys)))
        at = (mix64(keys ^ mix64(np.full(1, len(levels), np.uint64))) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append((size, np.packbits(alone)))
        keys = keys[~alone[at]]
    return levels


def probe_mph(levels: list[tuple[int, np.ndarray]], keys: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 where no level holds it; slots of the built keys are 0..n-1, each used once."""
    out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for k, (size, packed) in enumerate(levels):
        bits = np.unpackbits(packed, count=size)
        rank = np.cumsum(bits, dtype=np.int64)
        at = (mix64(keys[open_] ^ mix64(np.full(1, k, np.uint64))) % np.uint64(size)).astype(np.int64)
        hit = bits[at] == 1
        out[open_[hit]] = base + rank[at[hit]] - 1
        open_, base = open_[~hit], base + int(rank[-1])
    return out


def pack_shard(place: np.ndarray, fingerprint: np.ndarray, count: np.ndarray, last: np.ndarray) -> bytes:
    """Shard of rows (line hash, fingerprint, count in some documents, last of them); the rows of a line are added up."""
    order = np.lexsort((fingerprint, place))
    place, fingerprint, count, last = place[order], fingerprint[order], count[order], last[order]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (fingerprint[1:] != fingerprint[:-1])])[: len(place)]
    # of lines with equal hashes the first takes the slot, the others are listed
    first = np.concatenate([[True], place[1:] != place[:-1]])[: len(place)]
    line = np.cumsum(new) - 1
    fits = first[new]
    levels = build_mph(place[new][fits])
    slot = np.where(fits, probe_mph(levels, place[new]), 0)
    n, beside = int(fits.sum()), int((~fits).sum())
    slot[~fits] = n + np.arange(beside)
    keys, fingerprints = (np.empty(n + beside, np.uint64) for _ in range(2))
    keys[slot], fingerprints[slot] = place[new], fingerprint[new]
    counts, lasts = np.zeros(n + beside, np.int64), np.full(n + beside, -(2**63), np.int64)
    np.add.at(counts, slot[line], count)
    np.maximum.at(lasts, slot[line], last)
    head = struct.pack("<III", len(levels), n, beside) + b"".join(struct.pack("<Q", size) for size, _ in levels)
    return head + b"".join(bits.tobytes() for _, bits in levels) + b"".join(a.tobytes() for a in (fingerprints, counts, lasts, keys[n:]))


def open_shard(blob: bytes) -> tuple[list[tuple[int, np.ndarray]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Levels; fingerprint, count and last document by slot; the hashes of lines listed behind the slots."""
    n_levels, n, beside = struct.unpack_from("<III", blob)
    sizes = struct.unpack_from(f"<{n_levels}Q", blob, 12)
    at, levels, arrays = 12 + 8 * n_levels, [], []
    for size in sizes:
        levels.append((size, np.frombuffer(blob, np.uint8, -(-size // 8), at)))
        at += -(-size // 8)
    for t, size in ((np.uint64, n + beside), (np.int64, n + beside), (np.int64, n + beside), (np.uint64, beside)):
        arrays.append(np.frombuffer(blob, t, size, at))
        at += arrays[-1].nbytes
    return levels, *arrays


def probe_shard(shard: tuple, place: np.ndarray, fingerprint: np.ndarray) -> np.ndarray:
    """Slot of each line, -1 where the shard does not hold it."""
    levels, fingerprints, _, _, beside = shard
    slot = probe_mph(levels, place)
    slot = np.where((slot >= 0) & (fingerprints[slot] == fingerprint), slot, -1) if len(fingerprints) else slot
    for k, key in enumerate(beside.tolist()):
        at = len(fingerprints) - len(beside) + k
        slot[(place == np.uint64(key)) & (fingerprint == fingerprints[at])] = at
    return slot


def _line_key(line):
    return F.translate(F.btrim(line, F.lit(_WHITE)), _UPPER, _LOWER)


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    blob = pack_shard(rows["h1"].to_numpy().view(np.uint64), rows["h2"].to_numpy().view(np.uint64), rows["n"].to_numpy(), rows["last"].to_numpy())
    return pd.DataFrame({"shard": [key[0]], "blob": [blob]})


def _probe(min_docs: int):
    def run(probes: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        if not len(shards) or not len(probes):
            return probes.iloc[:0][["id", "th", "pos"]]
        shard = open_shard(shards["blob"].iloc[0])
        _, _, count, last, _ = shard
        slot = probe_shard(shard, probes["h1"].to_numpy().view(np.uint64), probes["h2"].to_numpy().view(np.uint64))
        gone = (slot >= 0) & (count[slot] >= min_docs) & (last[slot] != probes["key_id"].to_numpy())
        return probes.loc[gone, ["id", "th", "pos"]]

    return run


def _kept(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, drops in batches:
        kept, n, gone = [], [], []
        for text, drop in zip(texts, drops, strict=True):
            lines = (text or "").split("\n")
            n.append(len(lines))
            if drop is not None and len(drop):
                out = set(drop.tolist())
                gone.append(len(out))
                kept.append("\n".join(x for k, x in enumerate(lines) if k not in out))
            else:
                gone.append(0)
                kept.append(text or "")
        yield pd.DataFrame({"text": kept, "n_lines": n, "n_dropped": gone})


def salted_probes(lines: DataFrame, loads: DataFrame, n_shards: int, probes_per_task: int) -> tuple[DataFrame, DataFrame]:
    """lines with shard and salt, and (of, salts): a shard with `load` probes deals them to so many copies that each gets about `probes_per_task` at most."""
    copies = materialize(loads.select(F.col("shard").alias("of"), F.greatest(F.ceil(F.col("load") / probes_per_task), F.lit(1)).cast("int").alias("salts")), "copies")
    several = copies.where("salts > 1")
    several = F.broadcast(several) if n_shards <= MAX_SENT else several
    placed = lines.withColumn("shard", F.pmod("h1", F.lit(n_shards))).join(several, F.col("shard") == F.col("of"), "left")
    return placed.withColumn("salt", F.pmod(F.xxhash64("id", "th", "pos"), F.coalesce("salts", F.lit(1))).cast("int")).drop("of", "salts"), copies


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, shard_keys: int = 200_000, probes_per_task: int = 200_000, counts: bool = True) -> DataFrame:
    """All columns of docs with the cleaned text, plus (with counts) n_lines and n_dropped, which replace columns so named.

    A line goes if its key (white space stripped, A-Z lower-cased) has min_chars code points or more and is
    found in min_docs documents or more, except in the largest doc_id that holds it.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    lines = (
        base.select("id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("id", "th", "pos", _line_key(F.col("line")).alias("line"))
        .where(F.length("line") >= min_chars)
        .select(F.col("id"), "th", "pos", F.coalesce("id", F.lit(-(2**63))).alias("key_id"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("fingerprint"), "line").alias("h2"))
    )
    lines = materialize(lines, "lines")
    # each (line, document) once, then partial sums by groups of documents: a hot line is split over PARTS rows
    held = lines.groupBy("h1", "h2", "key_id").agg(F.count(F.lit(1)).alias("times"))
    partial = held.groupBy("h1", "h2", F.pmod(F.xxhash64("key_id"), F.lit(PARTS)).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.max("key_id").alias("last"), F.sum("times").alias("times"))
    partial = materialize(partial, "line-counts")
    n_shards = max(1, math.ceil(partial.count() / shard_keys))
    partial = partial.withColumn("shard", F.pmod("h1", F.lit(n_shards)))
    loads = partial.groupBy("shard").agg(F.sum("times").alias("load"))
    probes, copies = salted_probes(lines, loads, n_shards, probes_per_task)
    shards = partial.select("h1", "h2", "n", "last", "shard").groupBy("shard").applyInPandas(_build, "shard long, blob binary")
    shards = shards.join(copies.withColumnRenamed("of", "k"), F.col("shard") == F.col("k")).select("shard", "blob", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    hits = probes.groupBy("shard", "salt").cogroup(shards.groupBy("shard", "salt")).applyInPandas(_probe(min_docs), "id long, th long, pos int")
    drops = hits.groupBy("id", "th").agg(F.collect_set("pos").alias("__qf_drop")).select(F.col("id").alias("__qf_id"), F.col("th").alias("__qf_th"), "__qf_drop")
    clean = F.pandas_udf(_kept, "text string, n_lines long, n_dropped long")
    rows = docs.withColumn("__qf_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = rows.join(drops, rows["doc_id"].cast("long").eqNullSafe(drops["__qf_id"]) & (rows["__qf_hash"] == drops["__qf_th"]), "left")
    out = joined.withColumn("__qf_out", clean("text", "__qf_drop"))
    made = {x: F.col(f"__qf_out.{x}") for x in (("text", "n_lines", "n_dropped") if counts else ("text",))}
    return out.select(*[made.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns], *[v.alias(k) for k, v in made.items() if k not in docs.columns])
