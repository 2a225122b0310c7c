"""Shards by balanced label propagation.

Documents that share a link key (here: equal texts) are neighbours. A link key is a hub, so a group of c copies costs c
rows and no pair of them.

1. Linked documents begin in shards by hash.
2. In each round every hub counts its documents by shard (partial counts before the shuffle) and names the shard with
   most of them that has room; documents move there where no fewer neighbours are. What enters a shard may not exceed
   its quota less what stays: where more want in, hubs of a small enough hash move whole; of a hub that is large
   beside a quota a share of its documents moves, so it fills shard after shard.
3. Rounds end when hardly any document moves. Linked documents over a quota (by the shares, which are only expected
   values) go where room is left, and documents without a link fill all shards to quotas that differ by one row at most.

Places in shards come from counts of bounded buckets and a window in each bucket: no shard is gathered in a task. What
the driver sees is bounded: sums by pair of shards, and the counts of at most BUCKETS buckets of each shard, which are
sent to the tasks.

Defined cases: null text is empty (and equal to other empty texts); a null doc_id stays null; repeated rows are rows of
their own and neighbours; texts are equal if two hashes, 96 bits, and the length are; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, materialize

BUCKETS = 5_000
BUCKET_ROWS = 20_000
ROUNDS = 12
CALM = 1e-3  # rounds end when this share of the linked documents moves


def quotas(n: int, shards: int) -> np.ndarray:
    """Rows of each shard, at most one apart."""
    return np.array([n // shards + (s < n % shards) for s in range(shards)], np.int64)


def entry_shares(wanted: np.ndarray, size: np.ndarray, quota: np.ndarray) -> np.ndarray:
    """Share of the documents that want into each shard which may move, so that no shard passes its quota.

    wanted[s, t] documents of s want to t. Shares start at 1 and are cut where too many enter; what leaves a shard makes room.
    """
    share = np.ones(len(size))
    into = wanted.sum(0)
    for _ in range(100):
        left = (wanted * share).sum(1)
        new = np.minimum(share, np.maximum(0, quota - size + left) / np.maximum(into, 1))
        if np.abs(new - share).max() < 1e-6:
            break
        share = new
    return share


def _pick(values: list, at: Column) -> Column:
    """values[at]; at most as many values as there are shards."""
    return F.get(F.array(*[F.lit(x) for x in values]), at)


def _unit(*columns) -> Column:
    """A number from 0 up to 1 by hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) * F.lit(2.0**-53)


def _place_in(rows: DataFrame, group: str, spread: Column) -> DataFrame:
    """rows with place, their number from 0 on in their group (an int from 0 to some dozens); `spread` says what goes in one bucket."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("c"))
    n = sizes.agg(F.max("c")).first()[0] or 0
    count = min(BUCKETS, max(1, math.ceil(n / BUCKET_ROWS)))
    rows = materialize(rows.withColumn("bucket", F.pmod(spread, F.lit(count)).cast("int")), "bucketed")
    before = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(group, "bucket").agg(F.count(F.lit(1)).alias("c"))
    ahead = counts.select(F.col(group).alias("g"), F.col("bucket").alias("b"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy(group, "bucket").orderBy("hub", "rid")) - 1
    ranked = rows.withColumn("inside", inside)
    joined = ranked.join(F.broadcast(ahead), (F.col(group) == F.col("g")) & (F.col("bucket") == F.col("b")))
    return joined.withColumn("place", F.col("ahead") + F.col("inside")).drop("g", "b", "ahead", "inside", "bucket")


def _fill(rows: DataFrame, room: np.ndarray, at: Column, out: str) -> DataFrame:
    """rows dealt to shards with `room` in order of `at`; `out` is the shard, `within` the number of those dealt there before."""
    ends = np.cumsum(room).tolist()
    begins = [e - r for e, r in zip(ends, room.tolist(), strict=True)]
    shard = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= at))
    return rows.withColumn(out, shard).withColumn("within", at - _pick(begins, F.col(out)))


def propagate(linked: DataFrame, quota: np.ndarray) -> DataFrame:
    """linked (rid, hub, c: documents of the hub) with the shard of each row, after rounds of propagation."""
    shards = len(quota)
    now = materialize(linked.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")), "shards")
    large = max(1, int(quota.max()) // 50)
    size = np.zeros(shards, np.int64)
    for s, c in now.groupBy("shard").count().collect():
        size[s] = c
    total = int(size.sum())
    for round_ in range(ROUNDS):
        votes = now.groupBy("hub").agg(F.first("c").alias("c"), *[F.count(F.when(F.col("shard") == s, 1)).alias(f"v{s}") for s in range(shards)])
        room = quota - size
        open_ = room >= 0.01 * quota if (room >= 0.01 * quota).any() else np.ones(shards, bool)
        # of the open shards with most documents the one that the hub's hash says
        ranked = F.array(*[F.struct(F.col(f"v{s}").alias("n"), F.pmod(F.xxhash64("hub", F.lit(s)), F.lit(1 << 20)).alias("tie"), F.lit(s).alias("shard")) for s in range(shards) if open_[s]])
        votes = votes.select(F.col("hub").alias("k"), "c", F.array(*[f"v{s}" for s in range(shards)]).alias("votes"), F.array_max(ranked).alias("best"))
        votes = materialize(votes.select("k", "c", "votes", F.col("best.shard").alias("to")), "votes")
        leaves = lambda s: (F.col("to") != s) & (F.get("votes", s) <= F.get("votes", F.col("to")))
        moves = F.explode(F.transform(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), leaves), lambda s: F.struct(s.alias("s"), F.get("votes", s).alias("n"))))
        wanted = np.zeros((shards, shards))
        for s, t, n in votes.select("to", moves.alias("x")).groupBy("x.s", "to").agg(F.sum("x.n")).collect():
            wanted[s, t] = n
        if wanted.sum() <= CALM * total:
            break
        share = entry_shares(wanted, size, quota).tolist()
        drawn = F.when(F.col("c") > large, _unit("rid", F.lit(round_))).otherwise(_unit("hub", F.lit(round_)))
        named = join_counted(now.drop("c"), ["hub"], votes, ["k"], total)
        moved = leaves(F.col("shard")) & (drawn < _pick(share, F.col("to")))
        now = materialize(named.select("rid", "hub", "c", F.when(moved, F.col("to")).otherwise(F.col("shard")).alias("shard")), "shards")
        before, size = size, np.zeros(shards, np.int64)
        for s, c in now.groupBy("shard").count().collect():
            size[s] = c
        if (wanted * share).sum() <= CALM * total and (np.abs(size - before) <= CALM * total).all():
            break
    return now


def assign(nodes: DataFrame, shards: int = 16) -> DataFrame:
    """nodes (rid: unique, hub: the key that links them, others) with shard and slot: rows of shards are at most one apart, slots count from 0."""
    n = nodes.count()
    if not n:
        return nodes.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    quota = quotas(n, shards)
    hubs = materialize(nodes.groupBy(F.col("hub").alias("k")).agg(F.count(F.lit(1)).alias("c"), F.min("rid").alias("first")), "hubs")
    linked = join_counted(nodes.select("rid", "hub"), ["hub"], hubs.where("c > 1").select("k", "c"), ["k"], n).select("rid", "hub", "c")
    placed = propagate(linked, quota)

    # a group's rows lie together in order of place, so that a quota cuts few groups; a large one is spread over buckets
    spread = F.when(F.col("c") > BUCKET_ROWS // 2, F.xxhash64("hub", "rid")).otherwise(F.xxhash64("hub"))
    placed = materialize(_place_in(placed, "shard", spread), "placed")
    size = np.zeros(shards, np.int64)
    for s, c in placed.groupBy("shard").count().collect():
        size[s] = c
    over = np.maximum(0, size - quota)
    before = (np.cumsum(over) - over).tolist()
    stays = F.col("place") < _pick(quota.tolist(), F.col("shard"))
    own = placed.where(stays).select("rid", "shard", F.col("place").alias("slot"))
    at = F.col("place") - _pick(quota.tolist(), F.col("shard")) + _pick(before, F.col("shard"))
    filled = np.minimum(size, quota)
    rest = _fill(placed.where(~stays), quota - filled, at, "to").select("rid", F.col("to").alias("shard"), (F.col("within") + _pick(filled.tolist(), F.col("to"))).alias("slot"))
    # shards take what is over in order, so the rows that each has got follow from its room
    room, left = quota - filled, int(over.sum())
    got = np.minimum(room, np.maximum(0, left - (np.cumsum(room) - room)))
    filled = filled + got

    alone = hubs.where("c = 1").select(F.col("first").alias("rid"), F.col("k").alias("hub"), F.lit(0).alias("all"))
    alone = _place_in(alone, "all", F.xxhash64("rid"))
    alone = _fill(alone, quota - filled, F.col("place"), "to").select("rid", F.col("to").alias("shard"), (F.col("within") + _pick(filled.tolist(), F.col("to"))).alias("slot"))
    dealt = own.union(rest).union(alone).withColumnRenamed("rid", "r")
    return nodes.join(dealt, F.col("rid") == F.col("r")).drop("r")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: shards by the law `rows`, equal texts together."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("th"), F.monotonically_increasing_id().alias("rid"))
    nodes = materialize(base.select("doc_id", "size", "text_crc32", "rid", F.struct("th", "text_crc32", "size").alias("hub")), "nodes")
    out = assign(nodes, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
