"""Removal of byte strings that repeat, by sorting suffixes (deep-shallow).

A byte goes if a string of `length` bytes that covers it also starts earlier (smaller doc_id, or an earlier place of
the same document). Suffixes are sorted where a repeat is possible only: every window of `length` bytes has one
anchor, the start of its k-gram of least hash, so equal windows have equal anchors at equal distance. The
windows of an anchor make one stretch of text.

1. Anchors are grouped by hash of k-gram. Those that stand alone are done. Of equal stretches all but the earliest
   repeat as a whole. Only where one anchor has unlike stretches are bytes compared:
2. the suffixes that start at such anchors, and the reversed prefixes that end there, are sorted: ternary multikey
   quicksort on wide characters down to a shallow depth, then blind tries for the groups that still share a prefix.
   Common-prefix lengths of neighbours split the order into classes; a window at distance l before its anchor equals
   another iff they agree in l bytes to the left and length - l to the right. The earliest of each class stays.
3. An anchor with more than `group_limit` unlike stretches is dealt over several groups first: its distances are
   halved, and in each half stretches stay together only if they share the bytes that all its windows hold; halves
   that are still too large are halved again. Windows at one single distance are equal or not, so there the least
   is taken by a grouped minimum and nothing is left to sort.

Defined cases: null text is empty; rows that share doc_id are ordered by text hash, and equal rows get one and the
same result; a null doc_id is the smallest; texts shorter than `length` stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize, mix64, small_batches

K = 24
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_PLACES = np.uint64((1 << 24) - 1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up = np.full(size, np.uint64(_BASE))
        down = np.full(size, np.uint64(_INVERSE))
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place."""
    up, down = _power_tables(len(data))
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    return mix64((total[k:] - total[:-k]) * down[: len(data) - k + 1])


def anchors(data: np.ndarray, length: int, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: hash, place, first and last window start of each anchor."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    w = length - k + 1
    found = []
    block = 1 << 22
    for at in range(0, n, block):  # windows from `at`; places fit 24 bits
        part = data[at : min(len(data), at + block + length - 1)]
        h = gram_hashes(part, k)
        m = min(block, n - at)
        key = (h & ~_PLACES) | np.arange(len(h), dtype=np.uint64)
        size = -(-len(key) // w) * w
        padded = np.full(size, _NONE)
        padded[: len(key)] = key
        grid = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(grid, 1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(behind[:m], ahead[w - 1 : w - 1 + m])
        place = (least & _PLACES).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        found.append((h[place[cut]], place[cut] + at, cut + at, np.concatenate([cut[1:], [m]]) - 1 + at))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _pack(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Place, and distances of the last and first window to the anchor."""
    return ((a << np.int64(14)) | ((a - hi) << np.int64(7)) | (a - lo)).astype(np.int64)


def _unpack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, shortest and longest distance."""
    return x >> 14, (x >> 7) & 0x7F, x & 0x7F


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _anchor_rows(length: int):
    names = ("h", "u", "id", "th", "x")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, size = [], 0
            for doc, th, text in zip(batch["id"], batch["th"], batch["text"], strict=True):
                raw = _bytes(text)
                h, a, lo, hi = anchors(np.frombuffer(raw, np.uint8), length)
                if not len(h):
                    continue
                stretch = [xxhash.xxh3_64_intdigest(raw[x : y + length]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                out.append((h.view(np.int64), np.array(stretch, np.uint64).view(np.int64), np.full(len(h), doc, np.int64), np.full(len(h), th, np.int64), _pack(a, lo, hi)))
                size += len(h)
                if size > 200_000:
                    yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out, strict=True)), strict=True)))
                    out, size = [], 0
            if out:
                yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def _contexts(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, th, text, asked in zip(batch["id"], batch["th"], batch["text"], batch["asked"], strict=True):
                raw = _bytes(text)
                for q in asked:
                    a, short, long = (int(v) for v in _unpack(np.int64(q["x"])))
                    out.append((q["h"], doc, th, q["x"], raw[a - long : a - short + length]))
            yield pd.DataFrame(out, columns=["h", "id", "th", "x", "ctx"]).astype({"h": "int64", "id": "int64", "th": "int64", "x": "int64"})

    return run


# --- deep-shallow sorting ---------------------------------------------------------------------------


def blind_trie_order(rows: list[bytes], depth: int) -> list[int]:
    """Order of rows that agree in `depth` bytes.

    Branching nodes keep only where they branch. A row goes down blindly by its bytes there, is compared with one leaf
    to find where it really parts, and is put in at that depth.
    """
    # node: [place, {byte: child}, a leaf below]; leaf: a list of equal rows
    root: list | None = None
    for k, row in enumerate(rows):
        if root is None:
            root = ["leaf", [k]]
            continue
        node = root
        while node[0] != "leaf":
            node = node[1].get(row[node[0]]) or next(iter(node[1].values()))
        other = rows[node[1][0]]
        if row == other:
            node[1].append(k)
            continue
        at = depth
        while row[at : at + 16] == other[at : at + 16]:
            at += 16
        while row[at] == other[at]:
            at += 1
        parent, node = None, root
        while node[0] != "leaf" and node[0] < at:
            parent, node = node, node[1][row[node[0]]]
        if node[0] == at:
            node[1][row[at]] = ["leaf", [k]]
            continue
        new = [at, {other[at]: node, row[at]: ["leaf", [k]]}]
        if parent is None:
            root = new
        else:
            parent[1][row[parent[0]]] = new
    order, stack = [], [root] if root else []
    while stack:
        node = stack.pop()
        if node[0] == "leaf":
            order += node[1]
        else:
            stack += [child for _, child in sorted(node[1].items(), reverse=True)]
    return order


def multikey_quicksort(group: np.ndarray, wide: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by group and the first `depth` wide characters; per place the run it is in and the characters that run shares.

    Ternary partition of all open runs side by side: each takes a pivot (median of three) at its own depth and falls
    apart into smaller, equal and larger rows; the equal ones go on with the next character.
    """
    n = len(group)
    order = np.argsort(group, kind="stable")
    cut = np.ones(n, bool)
    cut[1:] = group[order][1:] != group[order][:-1]
    level = np.zeros(n, np.int64)
    while True:
        run = np.cumsum(cut) - 1
        at = np.flatnonzero((np.bincount(run, minlength=1)[run] > 1) & (level < depth)) if n else np.empty(0, np.int64)
        if not len(at):
            return order, run, level
        head = np.concatenate([[True], run[at][1:] != run[at][:-1]])
        s, start = np.cumsum(head) - 1, np.flatnonzero(head)
        end = np.concatenate([start[1:], [len(at)]])
        char = wide[order[at], level[at]]
        pivot = np.sort(np.stack([char[start], char[(start + end - 1) // 2], char[end - 1]]), 0)[1][s]
        side = (char > pivot).astype(np.int64) + (char >= pivot)
        moved = np.argsort(3 * s + side, kind="stable")
        order[at] = order[at][moved]
        side = side[moved]
        level[at] += side == 1
        cut[at[1:][(side[1:] != side[:-1]) & ~head[1:]]] = True


def deep_shallow(group: np.ndarray, text: np.ndarray, shallow: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Order of fixed-width byte rows within groups and the common prefix of each with the one before (0 at a group's start).

    Multikey quicksort with eight-byte characters to `shallow` bytes; blind tries below.
    """
    n, width = text.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = text
    wide = padded.view(">u8").astype(np.uint64)
    order, run, level = multikey_quicksort(group, wide, min(-(-shallow // 8), wide.shape[1]))
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if n else np.empty(0, np.int64)
    ends = np.concatenate([starts[1:], [n]]).astype(np.int64) if n else starts
    for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
        rows = [text[k].tobytes() for k in order[a:b]]
        order[a:b] = order[a:b][blind_trie_order(rows, min(int(8 * level[a]), width))]
    common = np.zeros(n, np.int64)
    if n > 1:
        differ = text[order[1:]] != text[order[:-1]]
        common[1:] = np.where(differ.any(1), differ.argmax(1), width)
        common[1:][group[order[1:]] != group[order[:-1]]] = 0
    return order, common


def repeated_windows(group: np.ndarray, rank: np.ndarray, lo: np.ndarray, hi: np.ndarray, long: np.ndarray, ctx: list[bytes], length: int) -> np.ndarray:
    """Rows x distances (lo to hi of each row): whether the window also starts at a row of the same group with smaller rank.

    The anchor of a row is at place `long` of its ctx.
    """
    n, w = len(group), length - K + 1
    right, left = np.zeros((n, length), np.uint8), np.zeros((n, w), np.uint8)
    for i, c in enumerate(ctx):
        b = np.frombuffer(c, np.uint8)
        m = int(long[i])
        right[i, : len(b) - m] = b[m:]
        left[i, :m] = b[:m][::-1]
    out = np.zeros((n, w), bool)
    by_rank = np.argsort(rank, kind="stable")
    order_r, lcp_r = deep_shallow(group, right, K + 16)  # all rows of an anchor share its k-gram
    order_l, lcp_l = deep_shallow(group, left)
    new_r = np.concatenate([[True], group[order_r][1:] != group[order_r][:-1]])
    new_l = np.concatenate([[True], group[order_l][1:] != group[order_l][:-1]])
    class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(lo.min()), int(hi.max()) + 1):
        on = by_rank[(lo[by_rank] <= d) & (d <= hi[by_rank])]
        if len(on) < 2:
            continue
        class_r[order_r] = np.cumsum(new_r | (lcp_r < length - d))
        class_l[order_l] = np.cumsum(new_l | (lcp_l < d))
        _, first = np.unique(class_r[on] * (n + 1) + class_l[on], return_index=True)
        again = np.ones(len(on), bool)
        again[first] = False
        out[on[again], d] = True
    return out


def _runs(marks: np.ndarray, ids: np.ndarray, th: np.ndarray, x: np.ndarray) -> pd.DataFrame:
    """Marked window starts as runs (id, th, first, last)."""
    edge = np.diff(np.pad(marks.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, lo = np.nonzero(edge == 1)
    _, hi = np.nonzero(edge == -1)
    a = _unpack(x)[0][row]
    return pd.DataFrame({"id": ids[row], "th": th[row], "first": a - (hi - 1), "last": a - lo})


def _sort_contexts(length: int, rows_at_once: int = 30_000):
    def marks(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held, ignore_index=True)
        ids, th, x = (rows[c].to_numpy() for c in ("id", "th", "x"))
        a, _, long = _unpack(x)
        rank = np.empty(len(rows), np.int64)
        rank[np.lexsort((a, th, ids))] = np.arange(len(rows))
        _, group = np.unique(rows["g"].to_numpy(), return_inverse=True)
        return _runs(repeated_windows(group, rank, rows["lo"].to_numpy(), rows["hi"].to_numpy(), long, rows["ctx"].tolist(), length), ids, th, x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            if not len(batch):
                continue
            g = batch["g"].to_numpy()
            if held and size >= rows_at_once:
                # what belongs to the last group goes along
                cut = int(np.searchsorted(g != held[-1]["g"].iloc[-1], True))
                held.append(batch.iloc[:cut])
                batch = batch.iloc[cut:]
                if not len(batch):
                    continue
                yield marks(held)
                held, size = [], 0
            held.append(batch)
            size += len(batch)
        if held:
            yield marks(held)

    return run


def _split_crowded(contexts: DataFrame, length: int, group_limit: int) -> tuple[DataFrame, DataFrame]:
    """Contexts dealt over groups g of at most `group_limit` rows with their distances lo to hi, and the marks of windows split down to one distance."""
    open_ = contexts.select(F.col("h").alias("g"), "id", "th", "x", F.expr("cast((x >> 7) & 127 as int)").alias("lo"), F.expr("cast(x & 127 as int)").alias("hi"), F.lit(0).alias("d0"), F.lit(length - K).alias("d1"), "ctx")
    names = ["g", "id", "th", "x", "lo", "hi", "ctx"]
    few, alone = None, None
    while True:
        large = materialize(open_.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > group_limit).select(F.col("g").alias("k")), "crowded")
        if large.isEmpty():
            part = open_.select(names)
            return (part if few is None else few.union(part)), alone
        # one key for each group_limit rows at least, so this is a small part of the contexts
        named = F.broadcast(large)
        part = open_.join(named, open_["g"] == named["k"], "left_anti").select(names)
        few = part if few is None else few.union(part)
        mid = F.floor((F.col("d0") + F.col("d1")) / 2).cast("int")
        halves = open_.join(named, open_["g"] == named["k"], "left_semi").withColumn("d", F.explode(F.array(F.struct(F.col("d0").alias("a"), mid.alias("b")), F.struct((mid + 1).alias("a"), F.col("d1").alias("b")))))
        halves = halves.withColumns({"lo": F.greatest("lo", "d.a"), "hi": F.least("hi", "d.b")}).where("lo <= hi and d.a <= d.b")
        shared = F.expr(f"substring(ctx, cast((x & 127) - d.a + 1 as int), {length} - d.b + d.a)")
        halves = materialize(halves.select(F.xxhash64("g", "d.a", shared).alias("g"), "id", "th", "x", "lo", "hi", F.col("d.a").alias("d0"), F.col("d.b").alias("d1"), "ctx"), "halves")
        single = halves.where("d0 = d1").selectExpr(f"substring(ctx, cast((x & 127) - lo + 1 as int), {length}) as w", "id", "th", "(x >> 14) - lo as start")
        least = materialize(single.groupBy("w").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "th", "start")).alias("least")).withColumnRenamed("w", "v"), "windows")
        again = join_counted(single, ["w"], least, ["v"], least.agg(F.sum("c")).first()[0] or 0)
        again = again.where(F.struct("id", "th", "start") != F.col("least")).select("id", "th", F.col("start").alias("first"), F.col("start").alias("last"))
        alone = again if alone is None else alone.union(again)
        open_ = halves.where("d0 < d1")


def _result(length: int):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            out = []
            for text, found in zip(texts, spans, strict=True):
                raw = _bytes(text)
                if found is None or not len(found):
                    out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), text or ""))
                    continue
                first = np.array([f["first"] for f in found], np.int64)
                last = np.array([f["last"] for f in found], np.int64)
                change = np.bincount(first, minlength=len(raw) + 1) - np.bincount(last + length, minlength=len(raw) + 1)
                gone = np.cumsum(change)[:-1] > 0
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 100, group_limit: int = 5_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left, cut characters replaced)."""
    small_batches(docs.sparkSession)
    base = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("th", F.xxhash64("text"))
    rows = materialize(base.select("id", "th", "text").mapInPandas(_anchor_rows(length), "h long, u long, id long, th long, x long"), "anchors")
    # grouped counts and minima are added up before they are shuffled, and hot keys are sent to the rows: no task needs all rows of an anchor
    again = rows.groupBy("h").agg(F.count(F.lit(1)).alias("c"), (F.min("u") != F.max("u")).alias("unlike")).where("c > 1").withColumnRenamed("h", "k")
    again = materialize(again, "again")
    n_shared = again.agg(F.sum("c")).first()[0] or 0
    shared = materialize(join_counted(rows, ["h"], again, ["k"], n_shared).select("h", "u", "id", "th", "x", "unlike"), "shared")
    place = F.struct("id", "th", F.shiftright("x", 14).alias("at"))
    first = shared.groupBy("h", "u").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("top")).withColumnsRenamed({"h": "k", "u": "v"})
    first = materialize(first, "stretches")
    found = join_counted(shared, ["h", "u"], first, ["k", "v"], n_shared).select("h", "id", "th", "x", "unlike", (place != F.col("top")).alias("later"))
    found = materialize(found.where("unlike or later").distinct(), "found")  # repeated rows count once from here
    asked = found.where("not later").groupBy("id", "th").agg(F.collect_list(F.struct("h", "x")).alias("asked"))
    asked = asked.select(F.col("id").alias("qid"), F.col("th").alias("qth"), "asked")
    contexts = base.select("id", "th", "text").join(asked, (F.col("id") == F.col("qid")) & (F.col("th") == F.col("qth"))).select("id", "th", "text", "asked")
    contexts = contexts.mapInPandas(_contexts(length), "h long, id long, th long, x long, ctx binary").dropDuplicates(["h", "id", "th", "x"])
    few, alone = _split_crowded(materialize(contexts, "contexts"), length, group_limit)
    marks = few.repartition("g").sortWithinPartitions("g").mapInPandas(_sort_contexts(length), "id long, th long, first long, last long")
    whole = found.where("later").selectExpr("id", "th", "(x >> 14) - (x & 127) as first", "(x >> 14) - ((x >> 7) & 127) as last")
    spans = whole.union(marks) if alone is None else whole.union(marks).union(alone)
    spans = spans.groupBy("id", "th").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    spans = materialize(spans.select(F.col("id").alias("sid"), F.col("th").alias("sth"), "spans"), "spans")
    rows = base.join(spans, (F.col("id") == F.col("sid")) & (F.col("th") == F.col("sth")), "left")
    result = F.pandas_udf(_result(length), "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    return rows.select("doc_id", result("text", "spans").alias("r")).select("doc_id", "r.*")
