"""MinHash near-dedup with tensored banding.

Two small collections of half-keys A and B (each half-key hashes `rows` minhashes) form m * m table keys by
combining pairs (A_i, B_j), so m * m tables cost 2 * m * rows minhashes. Texts with equal shingle sets are
one class first. Classes that meet in a table bucket are candidates:

1. The smallest member of a bucket is its hub, and buckets with one hub are taken as one. The hub is compared with
   every other member on full sets, so all its links there are known and it leaves the bucket. A bucket with one
   member left, or whose members are all linked with the hub, is done.
2. What is left is confirmed over all pairs in blocks of bounded size: the members of the buckets that hang together,
   or bucket by bucket, whichever means fewer copies of sets. Only a spanning forest of links leaves a task.
3. The components of all confirmed links are found.

A hub with many candidates has its set copied to several tasks; minima and counts are added up before they are shuffled.

Defined cases: null or empty texts have an empty set and stay alone; a text with fewer words than a shingle is
one shingle; rows with a null doc_id are kept and belong to no component; rows that share doc_id count as
one document; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize, mix64, small_batches
from .components import connected_components

MISS = 1e-4
HUB = 500  # candidates compared with one copy of a hub's set


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z lower-cased, words parted by ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = mix64(h[:n] + np.uint64(width))
    for k in range(1, width):
        out = mix64(out + h[k : k + n])
    return np.unique(out)


def half_keys(shingles: np.ndarray, multipliers: np.ndarray, rows: int) -> np.ndarray:
    """2 * m half-keys from the minima under each multiplier."""
    least = np.full(len(multipliers), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 8192):
        np.minimum(least, (shingles[at : at + 8192, None] * multipliers).min(0), out=least)
    out = np.zeros(len(multipliers) // rows, np.uint64)
    for r in range(rows):
        out = mix64(out + least[r::rows])
    return mix64(out + np.arange(len(out), dtype=np.uint64))


def tables_for(similarity: float, rows: int) -> int:
    """Half-keys a side so that a pair at the threshold misses with a probability of MISS a side at most."""
    return math.ceil(math.log(MISS) / math.log(1 - similarity**rows))


def _features(width: int, m: int, rows: int):
    multipliers = mix64(np.arange(1, 2 * m * rows + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("hi", "lo", "n", "a", "b")}
            for text in batch["text"]:
                s = shingle_set(text, width)
                d = xxhash.xxh3_128_digest(s.tobytes())
                keys = half_keys(s, multipliers, rows).view(np.int64) if len(s) else np.empty(0, np.int64)
                out["hi"].append(int.from_bytes(d[:8], "little", signed=True))
                out["lo"].append(int.from_bytes(d[8:], "little", signed=True))
                out["n"].append(len(s))
                out["a"].append(keys[:m])
                out["b"].append(keys[m:])
            yield pd.DataFrame({"id": batch["id"].astype("Int64"), "th": batch["th"]} | out)

    return run


def _sets(width: int):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda x: shingle_set(x, width).tobytes())

    return run


def link_block(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Smallest linked index for each set, over all pairs with 100 * intersection >= percent * union."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(x: int, y: int) -> None:
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)

    if n <= 24:
        for x in range(1, n):
            for y in range(x):
                a, b = sizes[x], sizes[y]
                if find(x) == find(y) or 100 * min(a, b) < percent * max(a, b):
                    continue
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= percent * (a + b - both):
                    join(x, y)
        return np.array([find(x) for x in range(n)])
    # shared hashes are the columns; the product of 0/1 blocks counts every intersection
    owner = np.repeat(np.arange(n), sizes)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(column, minlength=len(values)) > 1
    column = np.where(shared[column], (np.cumsum(shared) - 1)[column], -1)
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n, n), np.float32)
    wide = 2048
    for at in range(0, int(shared.sum()), wide):
        lo, hi = np.searchsorted(column, [at, at + wide])
        part = np.zeros((n, wide), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        held = np.unique(owner[lo:hi])
        sub = part[held]
        both[np.ix_(held, held)] += sub @ sub.T
    for x in range(n):
        inter = np.rint(both[x, :x]).astype(np.int64)
        for y in np.flatnonzero(100 * inter >= percent * (sizes[x] + sizes[:x] - inter)):
            if find(x) != find(int(y)):
                join(x, int(y))
    return np.array([find(x) for x in range(n)])


def _confirm(percent: int):
    def links(rows: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
        rows.sort(key=lambda r: r[0])
        least = link_block([np.frombuffer(b, np.uint64) for _, b in rows], percent)
        return [(rows[k][0], rows[r][0]) for k, r in enumerate(least) if r != k]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for batch in batches:
            out = []
            for *unit, node, s in zip(batch["kind"], batch["unit"], batch["i"], batch["j"], batch["id"], batch["set"], strict=True):
                if key != unit:
                    out += links(held) if len(held) > 1 else []
                    key, held = unit, []
                held.append((node, s))
            yield pd.DataFrame(out, columns=["u", "v"]).astype("int64")
        yield pd.DataFrame(links(held) if len(held) > 1 else [], columns=["u", "v"]).astype("int64")

    return run


def _compare(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            linked = []
            for a, b in zip(batch["su"], batch["sv"], strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                at = np.searchsorted(a, b)
                both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
                linked.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.loc[np.array(linked, bool), ["u", "v"]]

    return run


def _compared(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those candidate edges (u, v) whose sets are similar; the set of a v with many u is copied."""
    counts = edges.groupBy("v").agg(F.count("u").alias("c")).withColumnRenamed("v", "k")
    copies = F.ceil(F.col("c") / HUB).cast("int")
    dealt = join_counted(edges, ["v"], counts, ["k"], edges.count()).select("u", "v", F.pmod(F.xxhash64("u"), copies).cast("int").alias("copy"))
    hubs = counts.join(sets.select(F.col("id").alias("hid"), F.col("set").alias("sv")), F.col("k") == F.col("hid"))
    hubs = hubs.select("k", "sv", F.explode(F.sequence(F.lit(0), copies - 1)).alias("n"))
    both = dealt.join(sets.select(F.col("id").alias("uid"), F.col("set").alias("su")), F.col("u") == F.col("uid"))
    both = both.join(hubs, (F.col("v") == F.col("k")) & (F.col("copy") == F.col("n")))
    return both.select("u", "v", "su", "sv").mapInPandas(_compare(percent), "u long, v long")


def _left_over(tables: DataFrame, sets: DataFrame, percent: int, block_docs: int, block_shingles: int) -> DataFrame:
    """Links (u, v) that span what the members of buckets (key, rep, n) are linked by, over all pairs in blocks."""
    blocks = lambda c, s: F.greatest(F.ceil(F.col(c) / block_docs), F.ceil(F.col(s) / block_shingles)).cast("int")
    by_table = tables.groupBy("key").agg(F.count("rep").alias("c"), F.sum("n").alias("s"), F.min("rep").alias("hub")).withColumnRenamed("key", "k")
    by_table = materialize(by_table.withColumn("nb", blocks("c", "s")), "left-tables")
    total = by_table.agg(F.sum("c")).first()[0] or 0
    edges = join_counted(tables, ["key"], by_table, ["k"], total).select(F.col("rep").alias("u"), F.col("hub").alias("v"))
    groups = materialize(connected_components(edges), "groups").withColumnsRenamed({"id": "gid"})
    member = tables.select("rep", "n").distinct().join(groups, F.col("rep") == F.col("gid"))
    by_group = member.groupBy("root").agg(F.count("rep").alias("gc"), F.sum("n").alias("gs")).withColumnRenamed("root", "groot").withColumn("gnb", blocks("gc", "gs"))
    cost = by_table.join(groups, F.col("hub") == F.col("gid")).groupBy("root").agg(F.sum(F.col("c") * F.col("nb")).alias("cost"))
    plan = by_group.join(cost, F.col("groot") == F.col("root")).select("groot", F.col("gc").alias("c"), F.col("gnb").alias("gnb"), (F.col("gc") * F.col("gnb") <= F.col("cost")).alias("whole"))
    plan = materialize(plan, "left-groups")
    whole = join_counted(member.select("rep", "root"), ["root"], plan.where("whole"), ["groot"], total).select(F.lit(0).alias("kind"), F.col("root").alias("unit"), "rep", F.col("gnb").alias("nb"))
    apart = by_table.join(groups, F.col("hub") == F.col("gid")).join(plan.where("not whole").select("groot"), F.col("root") == F.col("groot")).select("k", "c", "nb")
    apart = join_counted(tables, ["key"], apart, ["k"], total).select(F.lit(1).alias("kind"), F.col("key").alias("unit"), "rep", "nb")
    dealt = sets.join(whole.union(apart), F.col("id") == F.col("rep")).withColumn("at", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select("kind", "unit", F.least("at", "k").alias("i"), F.greatest("at", "k").alias("j"), "id", "set")
    order = ["kind", "unit", "i", "j"]
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInPandas(_confirm(percent), "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = 3, block_docs: int = 1500, block_shingles: int = 1_500_000) -> DataFrame:
    """One row per row of docs: id (its doc_id), th (hash of its text), n (set size), component (smallest doc_id reached; null for a null doc_id)."""
    small_batches(docs.sparkSession)
    m = tables_for(percent / 100, rows)
    base = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    feats = materialize(base.mapInPandas(_features(width, m, rows), "id long, th long, hi long, lo long, n long, a array<long>, b array<long>"), "minhash")
    classes = materialize(
        feats.where("n > 0 and id is not null").groupBy("hi", "lo")
        .agg(F.min("id").alias("rep"), F.min_by("th", "id").alias("th"), F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b")),
        "classes",
    )
    # A half-keys of one class alone go first; counts and minima are added up before the shuffle and joins split a hot key
    halves = classes.select("rep", "n", "b", F.explode("a").alias("ak"))
    met = halves.groupBy("ak").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("ak").alias("k"))
    pairs = materialize(halves.join(met, F.col("ak") == F.col("k")).select("rep", "n", F.explode(F.transform("b", lambda x: F.xxhash64("ak", x))).alias("key")), "tables")
    least = pairs.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("key").alias("k"), "hub")
    edges = pairs.join(least, F.col("key") == F.col("k")).where("rep <> hub.rep")
    edges = materialize(edges.select(F.col("rep").alias("u"), F.col("hub.rep").alias("v"), "n", F.col("hub.n").alias("hn")).distinct(), "candidates")
    final = None
    if not edges.isEmpty():
        member = edges.select("u").union(edges.select("v")).distinct().join(classes.select(F.col("rep").alias("crep"), F.col("th").alias("mth")), F.col("u") == F.col("crep"))
        held = base.join(member, (base["id"] == member["u"]) & (base["th"] == member["mth"])).dropDuplicates(["id", "th"])
        sets = materialize(held.select("id", F.pandas_udf(_sets(width), "binary")("text").alias("set")), "sets")
        # sets of unlike sizes can't be similar enough
        links = materialize(_compared(edges.where(100 * F.least("n", "hn") >= percent * F.greatest("n", "hn")).select("u", "v"), sets, percent), "links")
        # a bucket goes on if two or more are left and the hub is not linked with all of them
        apart = links.groupBy(F.col("v").alias("k")).agg(F.count("u").alias("linked"))
        sizes = edges.groupBy(F.col("v").alias("hub")).agg(F.count("u").alias("c"))
        open_ = sizes.join(apart, F.col("hub") == F.col("k"), "left").where("c > 1 and c > coalesce(linked, 0)").select("hub")
        left = materialize(edges.join(open_, F.col("v") == F.col("hub"), "left_semi").select(F.col("v").alias("key"), F.col("u").alias("rep"), "n"), "left")
        if not left.isEmpty():
            links = links.union(_left_over(left, sets, percent, block_docs, block_shingles))
        final = connected_components(links)
    named = feats.select("id", "th", "n", "hi", "lo").join(classes.select(F.col("hi").alias("chi"), F.col("lo").alias("clo"), "rep"), (F.col("hi") == F.col("chi")) & (F.col("lo") == F.col("clo")) & (F.col("n") > 0), "left")
    node = named.select("id", "th", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep"))
    if final is None:
        return node.withColumnRenamed("rep", "component")
    out = node.join(final.select(F.col("id").alias("fid"), F.col("root").alias("froot")), F.col("rep") == F.col("fid"), "left")
    return out.select("id", "th", "n", F.coalesce("froot", "rep").alias("component"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but the smallest doc_id of each component; of repeated rows with that doc_id one stays."""
    found = near_duplicates(docs, width, percent).where("id is null or id = component").select(F.col("id").alias("__qf_id"), F.col("th").alias("__qf_th")).distinct()
    rows = docs.withColumn("__qf_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = rows.join(found, rows["doc_id"].cast("long").eqNullSafe(found["__qf_id"]) & (rows["__qf_hash"] == found["__qf_th"]), "left_semi")
    return kept.drop("__qf_hash")
