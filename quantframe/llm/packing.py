"""Cost-balanced packing of token ids into fixed-length sequences.

Each task tokenizes its documents and packs them in blocks: whole pieces of `capacity` ids are sequences
of their own; what remains of each document is taken in descending estimated cost (linear plus quadratic
attention cost) and goes to the sequence of lowest cost that has room. A block opens just as many
sequences as its ids need; a remainder that fits nowhere whole is cut over the sequences with most room.
No shuffle, and no more than a block of documents in memory.

Defined cases: null text is empty (the document is its end id alone); repeated rows are packed as often as
they occur; a null doc_id stays null; an empty table gives no pieces. Sequence ids are unique over all
tasks (task number, then a counter) and the same when a task is run again.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import small_batches

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoder(path: str, special: dict[str, int]):
    """The byte-level BPE of a rank file; gives the ids that the tokenizers library gives for the same vocabulary, several times faster."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """(item, start in item, length, bin) for items of less than `capacity`; all bins but a few are full."""
    cost = lambda n: linear * n + quadratic * n * n
    n_bins = -(-sum(lengths) // capacity)
    room = [capacity] * n_bins
    load = [(0.0, b) for b in range(n_bins)]
    out, whole = [], sorted(range(len(lengths)), key=lambda k: (-cost(lengths[k]), k))
    rest = []
    for k in whole:
        n, tried = lengths[k], []
        while load and room[load[0][1]] < n:
            tried.append(heapq.heappop(load))
        if load:
            c, b = heapq.heappop(load)
            out.append((k, 0, n, b))
            room[b] -= n
            if room[b]:
                heapq.heappush(load, (c + cost(n), b))
        else:
            rest.append(k)
        for x in tried:
            heapq.heappush(load, x)
    spare = [(-r, b) for b, r in enumerate(room) if r]
    heapq.heapify(spare)
    for k in rest:
        start, left = 0, lengths[k]
        while left:
            r, b = heapq.heappop(spare)
            n = min(left, -r)
            out.append((k, start, n, b))
            start, left = start + n, left - n
            if r + n:
                heapq.heappush(spare, (r + n, b))
    return out


def _pack(path: str, special: dict[str, int], end_id: int, capacity: int, linear: float, quadratic: float, block: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, special)
        first = TaskContext.get().partitionId() << 40
        state = {"next": first}

        def rows_of(docs: list[tuple[object, np.ndarray]]) -> pd.DataFrame:
            rows, tails = [], []
            for doc_id, ids in docs:
                cut = len(ids) - len(ids) % capacity
                for at in range(0, cut, capacity):
                    rows.append((doc_id, at, capacity, zlib.crc32(ids[at : at + capacity]), len(ids), state["next"], 0))
                    state["next"] += 1
                if cut < len(ids):
                    tails.append((doc_id, ids, cut))
            fill: dict[int, int] = {}
            for k, start, n, b in assign([len(ids) - cut for _, ids, cut in tails], capacity, linear, quadratic):
                doc_id, ids, cut = tails[k]
                at = cut + start
                rows.append((doc_id, at, n, zlib.crc32(ids[at : at + n]), len(ids), state["next"] + b, fill.get(b, 0)))
                fill[b] = fill.get(b, 0) + n
            state["next"] += len(fill)
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            return out.astype({"doc_id": "Int64"})

        held, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(enc.encode_to_numpy(text or "", allowed_special="all"), np.uint32(end_id)).astype("<u4")
                held.append((None if pd.isna(doc_id) else int(doc_id), ids))
                size += len(ids)
                if len(held) >= block or size >= block * capacity:
                    yield rows_of(held)
                    held, size = [], 0
        if held:
            yield rows_of(held)

    return run


def pack(docs: DataFrame, rank_file: str, special: dict[str, int], end_id: int = 0, capacity: int = 1024, linear: float = 1.0, quadratic: float = 1.0 / 4096, block: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    small_batches(docs.sparkSession)
    texts = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return texts.mapInPandas(_pack(rank_file, special, end_id, capacity, linear, quadratic, block), PIECES)
