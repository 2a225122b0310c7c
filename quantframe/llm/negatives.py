"""Hard-negative mining by a pivot table.

1. A further coordinate, sqrt(M^2 - |x|^2) for a row and 0 for an anchor (M the greatest norm of all rows), turns the
   inner product into a Euclidean distance: d^2 = |q|^2 + M^2 - 2 q.x.
2. Pivots are taken farthest first from a sample of about SAMPLE rows. The pivot table holds
   the distances of every row to all pivots; it is cut into blocks of near rows by range, so that neither a label nor
   copies of one vector fill a block beyond its size.
3. By the triangle inequality, pivot distances bracket the distance, and so the score, of anchor and row. An anchor
   goes to those blocks alone whose brackets reach the scores it asks for; in a block, rows outside the bracket are
   left out and the survivors' exact scores are taken. What an anchor asks for is bounded from below by its k-th best
   row of the sample, which is a row of the table, so nothing is lost.
4. The best of each block are merged: first the positives, then with their scores the negatives.

Blocks are held one at a time and anchors stream past them; rows reach a task as often as there are SALTED anchors.
The table of blocks (at most MAX_BLOCKS rows of 2 distances a pivot) goes to the tasks that route anchors. Brackets
are widened for rounding, scores are exact (whole numbers: doubles below 2^53, Python's beyond; a score beyond 64 bits
is an error).

Defined cases: rows with a null id, label or vector or with a null or non-finite component take no part; a component
missing beside longer vectors is 0; rows repeated whole count once, other rows that share an id are rows of their own
(an anchor with a shared id is named by that id); an anchor without positives or negatives gives no rows; other columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

SAMPLE = 4096  # rows, as expected of a random share, from which pivots and first bounds are taken
MAX_BLOCKS = 32_768
SALTED = 200_000  # anchors for which a block is sent once more
EXACT = 2.0**53
_LEAST, _MOST = -(2**63), 2**63 - 1
_QUERY = "block int, salt int, kind int, id long, label long, v array<double>, dist array<double>, key long, lo array<long>, hi array<long>"
_FOUND = "anchor long, key long, band int, score long, other long"


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def scores_of(table: np.ndarray, norms: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products as long."""
    if len(table) and norms.max() * math.sqrt(q @ q) >= EXACT:
        wide = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in table]
        if any(not _LEAST <= x <= _MOST for x in wide):
            raise OverflowError("a score is beyond 64 bits")
        return np.array(wide, np.int64)
    return (table @ q).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    at = np.arange(len(scores))
    if len(at) > k:
        at = at[scores >= np.partition(scores, len(scores) - k)[len(scores) - k]]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


class Space:
    """Pivots and the augmented distances to them."""

    def __init__(self, sample: np.ndarray, count: int, square: float):
        self.square = square
        chosen = [int((sample**2).sum(1).argmax())] if len(sample) else []
        while 0 < len(chosen) < count:
            self._take(sample[chosen])
            far = self.of_rows(sample).min(1)
            if far.max() <= 0:
                break
            chosen.append(int(far.argmax()))
        self._take(sample[chosen])

    def _take(self, pivots: np.ndarray) -> None:
        self.pivots = pivots
        self.height = np.sqrt(np.maximum(0, self.square - (pivots**2).sum(1)))

    def _to(self, x: np.ndarray, height: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(((x - p) ** 2).sum(1) + (height - h) ** 2) for p, h in zip(self.pivots, self.height, strict=True)], 1)

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return self._to(x, np.sqrt(np.maximum(0, self.square - (x**2).sum(1))))

    def of_anchors(self, x: np.ndarray) -> np.ndarray:
        return self._to(x, np.zeros(len(x)))

    def reach(self, q: np.ndarray, lo: int, hi: int) -> tuple[float, float]:
        """Least and greatest distance at which a row's score with q can lie from lo to hi, widened for rounding."""
        all_, slack = q @ q + self.square, 1e-9 * (math.sqrt(q @ q) + math.sqrt(self.square)) + 1e-9
        near, far = (math.sqrt(max(0.0, all_ - 2.0 * x + 1e-10 * all_ * w)) for x, w in ((hi, -1), (lo, 1)))
        return -math.inf if hi == _MOST else near - slack, math.inf if lo == _LEAST else far + slack


class Block:
    """Rows in order of the pivot distance that spreads most."""

    def __init__(self, rows: pd.DataFrame, space: Space, width: int):
        v, d = matrix(rows["v"], width), np.stack(rows["dist"].to_list())
        ids, labels = rows["id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
        order = np.lexsort((*v.T, labels, ids))
        same = (ids[order][1:] == ids[order][:-1]) & (labels[order][1:] == labels[order][:-1]) & (v[order][1:] == v[order][:-1]).all(1)
        order = order[np.concatenate([[True], ~same])]
        self.by = int(np.ptp(d, axis=0).argmax())
        order = order[np.argsort(d[order, self.by], kind="stable")]
        self.v, self.d, self.ids, self.labels, self.space = v[order], d[order], ids[order], labels[order], space
        self.norms = np.sqrt((self.v**2).sum(1))

    def search(self, q: np.ndarray, dist: np.ndarray, own: int, label: int, same: bool, lo: list[int], hi: list[int], k: int) -> list[tuple[int, int, int]]:
        """(band, score, id) of the k best rows of each band; the rows' label is the anchor's, or is not."""
        near, far = self.space.reach(q, min(lo), max(hi))
        a, b = np.searchsorted(self.d[:, self.by], [dist[self.by] - far, dist[self.by] + far], "left")
        b = max(b, int(np.searchsorted(self.d[:, self.by], dist[self.by] + far, "right")))
        d = self.d[a:b]
        out = (np.abs(d - dist).max(1) > far) | ((d + dist).min(1) < near) | ((self.labels[a:b] == label) != same)
        at = a + np.flatnonzero(~out)
        if same:
            at = at[(self.ids[at] != own) | (self.v[at] != q).any(1)]
        scores, found = scores_of(self.v[at], self.norms[at], q), []
        for band, (least, most) in enumerate(zip(lo, hi, strict=True)):
            fits = np.flatnonzero((scores >= least) & (scores <= most))
            found += [(band, int(scores[fits[x]]), int(self.ids[at[fits[x]]])) for x in best(scores[fits], self.ids[at[fits]], k)]
        return found


def _table(space: Space, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = space.of_rows(matrix(batch["v"], width))
            yield batch.assign(dist=list(d), home=d.argmin(1), near=d.min(1))

    return run


def _route(shared, width: int, same: bool, k: int, bands: Callable[[object], list[tuple[int, int]]], salts: int):
    """Anchors, each for every block that can hold what it asks for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, sample, blocks = shared.value
        for batch in batches:
            vectors = matrix(batch["v"], width)
            dist, out = space.of_anchors(vectors), []
            for n, row in enumerate(batch.itertuples(index=False)):
                asked = bands(row)
                if not any(lo <= hi for lo, hi in asked):
                    continue
                lo, hi = [x for x, _ in asked], [x for _, x in asked]
                known: dict[int, list[int]] = {}
                for band, score, _ in sample.search(vectors[n], dist[n], row.id, row.label, same, lo, hi, k):
                    known.setdefault(band, []).append(score)
                lo = [max(x, known[band][-1]) if len(known.get(band, ())) == k else x for band, x in enumerate(lo)]
                open_ = [(x, y) for x, y in zip(lo, hi, strict=True) if x <= y]
                near, far = space.reach(vectors[n], min(x for x, _ in open_), max(y for _, y in open_))
                closest = np.maximum(blocks["low"] - dist[n], dist[n] - blocks["high"]).max(1)
                farthest = (blocks["high"] + dist[n]).min(1)
                fits = (blocks["first"] <= row.label) & (row.label <= blocks["last"]) if same else (blocks["first"] != row.label) | (blocks["last"] != row.label)
                for block in blocks["block"][fits & ~(closest > far) & ~(farthest < near)].tolist():
                    out.append((block, row.key % salts, 1, row.id, row.label, vectors[n], dist[n], row.key, lo, hi))
            yield pd.DataFrame(out, columns=["block", "salt", "kind", "id", "label", "v", "dist", "key", "lo", "hi"]).astype({x: "int32" for x in ("block", "salt", "kind")} | {x: "int64" for x in ("id", "label", "key")})

    return run


def _scan(shared, width: int, same: bool, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, now, parts, block = shared.value[0], None, [], None
        for batch in batches:
            out = []
            key = batch[["block", "salt", "kind"]].to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)] if len(key) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.iloc[a:b]
                if now != (unit := tuple(key[a, :2].tolist())):
                    now, parts, block = unit, [], None
                if key[a, 2] == 0:  # the rows of a block come before its anchors
                    parts.append(part)
                elif parts:
                    block = block or Block(pd.concat(parts), space, width)
                    for row in part.itertuples(index=False):
                        lo, hi = [int(x) for x in row.lo], [int(x) for x in row.hi]
                        for band, score, other in block.search(np.asarray(row.v), np.asarray(row.dist), row.id, row.label, same, lo, hi, k):
                            out.append((row.id, row.key, band, score, other))
            yield pd.DataFrame(out, columns=["anchor", "key", "band", "score", "other"]).astype({"anchor": "int64", "key": "int64", "band": "int32", "score": "int64", "other": "int64"})

    return run


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, pivots: int = 16, block_rows: int = 4096) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows and anchors (some of the rows): id, label, v (whole numbers as doubles). An anchor's positives are its
    `positives` best other rows of its label; the negatives of each are the `negatives` best rows of other labels
    with least * positive_score <= 100 * negative_score <= most * positive_score.
    """
    spark = rows.sparkSession
    small_batches(spark)
    clean = "id is not null and label is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    kinds = {"id": F.col("id").cast("long"), "label": F.col("label").cast("long"), "v": F.col("v").cast("array<double>")}
    rows, anchors = (x.select(*[v.alias(k) for k, v in kinds.items()]).where(clean) for x in (rows, anchors))
    count, width, square = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    if not count:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    sample = rows.sample(min(1.0, SAMPLE / count), seed=1).toPandas()
    space = Space(matrix(sample["v"], width), pivots, square)

    kept = rows.mapInPandas(_table(space, width), "id long, label long, v array<double>, dist array<double>, home int, near double")
    n_blocks = min(MAX_BLOCKS, max(1, math.ceil(count / block_rows)))
    kept = kept.repartitionByRange(n_blocks, "label", "home", "near", "id").select(F.spark_partition_id().alias("block"), "id", "label", "v", "dist")
    table = materialize(kept, "pivot-table")
    ends = [f(F.get("dist", F.lit(j))).alias(f"{x}{j}") for x, f in (("low", F.min), ("high", F.max)) for j in range(len(space.pivots))]
    held = table.groupBy("block").agg(F.min("label").alias("first"), F.max("label").alias("last"), *ends).orderBy("block").toPandas()
    blocks = {x: held[x].to_numpy() for x in ("block", "first", "last")} | {x: held[[f"{x}{j}" for j in range(len(space.pivots))]].to_numpy() for x in ("low", "high")}
    known = Block(sample.assign(dist=list(space.of_rows(matrix(sample["v"], width)))), space, width)
    shared = spark.sparkContext.broadcast((space, known, blocks))

    anchors = materialize(anchors.dropDuplicates().withColumn("key", F.xxhash64("id", "label", "v")), "anchors")
    salts = max(1, math.ceil(anchors.count() / SALTED))
    held = table.select("block", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "id", "label", "v", "dist", F.lit(0).cast("long").alias("key"), *[F.lit(None).cast("array<long>").alias(x) for x in ("lo", "hi")])

    def best_of(asking: DataFrame, same: bool, k: int, bands: Callable[[object], list[tuple[int, int]]]) -> DataFrame:
        asked = asking.mapInPandas(_route(shared, width, same, k, bands, salts), _QUERY)
        met = held.union(asked).repartition("block", "salt").sortWithinPartitions("block", "salt", "kind")
        found = met.mapInPandas(_scan(shared, width, same, k), _FOUND)
        order = Window.partitionBy("anchor", "key", "band").orderBy(F.col("score").desc(), "other")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = materialize(best_of(anchors, True, positives, lambda _: [(_LEAST, _MOST)]), "positives")
    groups = near.groupBy(F.col("anchor").alias("aid"), F.col("key").alias("akey")).agg(F.sort_array(F.collect_list(F.struct("rank", "score", "other"))).alias("near"))
    asking = materialize(anchors.join(groups, (F.col("id") == F.col("aid")) & (F.col("key") == F.col("akey"))).select("id", "label", "v", "key", F.col("near.score").alias("scores")), "asking")
    far = best_of(asking, False, negatives, lambda row: [(-(-least * int(x) // 100), most * int(x) // 100) for x in row.scores])
    far = far.select(F.col("anchor").alias("fid"), F.col("key").alias("fkey"), "band", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.select(F.col("anchor").alias("anchor_id"), "key", (F.col("rank") - 1).alias("place"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    out = named.join(far, (F.col("anchor_id") == F.col("fid")) & (F.col("key") == F.col("fkey")) & (F.col("place") == F.col("band")))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
