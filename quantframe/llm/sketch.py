"""Threshold-scaled document sketches, in DataFrame functions alone.

A sketch keeps every hash of a five-word shingle below a fixed fraction of the hash range, so sketches of any
sizes can be merged by union and compared by containment. A text with fewer words is one shingle; a text none
of whose hashes is below the threshold keeps its smallest one. Words are parted by ASCII white space; null
and empty texts are one empty word.

Neighbours in descending doc_id are found without a global sort: ids are cut into ranges of about `range_docs`
documents (more only beyond MAX_RANGES ranges), each range gets a copy of the first document of the next one, and a
window runs in each range. The cuts are quantiles of a sample of ids, as in a sort by Spark, so they follow the
ids however uneven those are; they decide where rows are handled, never what comes out. An id that fills several
ranges is cut by text hash. A null doc_id comes last; rows that share doc_id follow each other in descending text hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_WHITE = " \t\n\x0b\x0c\r"
WIDTH = 5
MAX_RANGES = 100_000  # bounds the cuts and the table of range ends, which go to all tasks
SAMPLED = 64  # ids looked at for each cut


def words(text: Column) -> Column:
    return F.split(F.btrim(text, F.lit(_WHITE)), r"[\x20\x09-\x0D]+")


def shingle_hashes(w: Column, width: int = WIDTH) -> Column:
    """Hash of each shingle of a column of words (let it be a column of its own, or it is split again for each word)."""
    part = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])
    return F.when(F.size(w) < width, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0))), part))


def with_sketch(df: DataFrame, text: str, out: str, fraction: float) -> DataFrame:
    """df with the sketch of a text column."""
    df = df.withColumn("__qf_words", words(F.col(text)))
    below = F.lit(min(int(-(2**63) + 2**64 * fraction), 2**63 - 1))
    df = df.withColumn("__qf_hashes", shingle_hashes(F.col("__qf_words"))).drop("__qf_words")
    df = df.withColumn("__qf_low", F.array_sort(F.array_distinct(F.filter("__qf_hashes", lambda x: x < below))))
    return df.withColumn(out, F.when(F.size("__qf_low") > 0, F.col("__qf_low")).otherwise(F.array(F.array_min("__qf_hashes")))).drop("__qf_hashes", "__qf_low")


def text_of(kept: str) -> Column:
    return F.array_join(F.transform(kept, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def jaccard(a: str, b: str) -> Column:
    both = F.size(F.array_intersect(a, b))
    return (both / (F.size(a) + F.size(b) - both)).cast("double")


def containment(a: str, b: str) -> Column:
    """Share of sketch a that sketch b holds."""
    return (F.size(F.array_intersect(a, b)) / F.size(a)).cast("double")


def _below(cuts: list[int], key: Column, equal: bool) -> Column:
    """How many of the sorted cuts are below key (or equal to it), by binary search."""
    held = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    value = lambda at: F.get(held, at - 1)
    fits = lambda at: (value(at) <= key) if equal else (value(at) < key)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & fits(at + step), at + step).otherwise(at))


def ranged(docs: DataFrame, range_docs: int = 1000) -> DataFrame:
    """docs (id, th, ...) with the number r of their range; ranges ascend with (id, th), null ids first."""
    key = F.coalesce("id", F.lit(-(2**63)))
    n = docs.select("id").count()
    ranges = min(max(1, n // range_docs), MAX_RANGES)
    if ranges == 1:
        return docs.withColumn("r", F.lit(0))
    some = docs.select(key.alias("key")).sample(min(1.0, SAMPLED * ranges / n), seed=1).agg(F.sort_array(F.collect_list("key")).alias("k"))
    cut = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get("k", F.floor(i * F.size("k") / ranges).cast("int")))
    cuts = [x for x in some.select(cut).first()[0] if x is not None]
    if not cuts:
        return docs.withColumn("r", F.lit(0))
    share = F.col("th").cast("double") / F.lit(2.0**64) + 0.5
    docs = docs.withColumn("__qf_lo", _below(cuts, key, False)).withColumn("__qf_m", _below(cuts, key, True) - F.col("__qf_lo"))
    return docs.withColumn("r", (F.col("__qf_lo") + F.least("__qf_m", F.floor(share * (F.col("__qf_m") + 1)).cast("int"))).cast("int")).drop("__qf_lo", "__qf_m")


def with_next(docs: DataFrame, range_docs: int = 1000, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """docs (id, th, text, ...), prepared, with the other columns of the next document in descending id as next_*.

    prepare adds columns to rows; it runs once on each document and on one copy for each range.
    """
    names = [c for c in docs.columns if c not in ("id", "th")]
    docs = ranged(docs, range_docs)
    order = F.struct(F.coalesce("id", F.lit(-(2**63))), "th")
    heads = docs.groupBy("r").agg(F.max(order).alias("top"))
    # a row for each range; the lowest range is followed by the highest
    down = Window.orderBy(F.col("r").desc())
    follow = heads.select(F.coalesce(F.lag("r").over(down), F.min("r").over(Window.partitionBy())).alias("above"), F.col("r").alias("at"), F.col("top").alias("top_"))
    ends = docs.join(F.broadcast(follow), (docs["r"] == follow["at"]) & (order == F.col("top_"))).groupBy("above").agg(F.first(F.struct(*names)).alias("x"))
    ends = ends.select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("th"), *[F.col(f"x.{c}").alias(c) for c in names], F.col("above").alias("r"), F.lit(True).alias("end"))
    rows = prepare(docs.select("id", "th", *names, "r", F.lit(False).alias("end")).union(ends))
    w = Window.partitionBy("r").orderBy("end", F.col("id").desc_nulls_last(), F.col("th").desc())
    carried = [c for c in rows.columns if c not in ("id", "th", "r", "end")]
    return rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried}).where(~F.col("end"))


def fingerprints(docs: DataFrame, fraction: float = 1 / 8) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (Jaccard of the sketches),
    and the containments of a document in its edited text and in the next document."""
    base = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    rows = with_next(base, prepare=lambda rows: with_sketch(rows, "text", "s", fraction))
    cut = F.floor(F.length("text") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next_text", F.lit(1), cut)))
    rows = with_sketch(rows.select("id", F.length("text").cast("long").alias("n_chars"), "s", "next_s", "edited"), "edited", "e", fraction)
    return rows.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        text_of("s").alias("fingerprint"), text_of("e").alias("edited_fingerprint"),
        jaccard("s", "e").alias("near_edited"), jaccard("s", "next_s").alias("near_next"),
        containment("s", "e").alias("contained_in_edited"), containment("s", "next_s").alias("contained_in_next"),
    )
