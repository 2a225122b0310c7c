"""Source divergence audit over wide term vectors.

1. Tasks count the terms of whole texts: a row for each (lang, source, term), with occurrences and documents, whenever
   HELD of them are held. Spark adds these up map-side and by a shuffle.
2. Each term of a language that enough of its documents hold is pivoted into one wide row: an array of counts with a
   place for each source of the language.
3. Higher-order functions turn counts into shares p in billionths and emit what the term adds to each pair of
   sources; the sums of pairs are made map-side, so a task sends one row a pair whatever its number of terms.
4. The terms that stand out in a source are ranked with a limit for each group before the shuffle.

All arithmetic is on integers, products with counts as decimals. The table of groups (lang, source) is broadcast only
up to MAX_GROUPS rows and joined by a shuffle beyond. A source with a third of all rows is no group of rows anywhere:
rows of documents are never grouped, only counts are.

Defined cases: null text, lang and source are ''; a group without a term counts 0 everywhere; a language without a kept
term gives pairs of value 0 and no terms; each row is a document, also where it repeats another or shares its doc_id
(which is not read and may be null); a long text is counted in pieces; other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: of UTF-8 bytes: letters and all above ASCII are parts of terms, A-Z count as a-z
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
PIECE = 1 << 20  # bytes of a text that are split at once
HELD = 400_000  # terms of groups that a task adds up before it hands them on
MAX_GROUPS = 100_000  # (lang, source) rows that may be broadcast
SCALE = 1_000_000_000


def terms_of(text: str | None, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text in order (UTF-8, A-Z lower-cased), in lists of about `piece` bytes."""
    raw, at = (text or "").encode("utf-8", "surrogatepass").translate(_TERMS), 0
    while at < len(raw):
        end = raw.find(b" ", at + piece)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    times: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def rows() -> Iterator[pd.DataFrame]:
        for (lang, source), counts in times.items():
            held = docs[lang, source]
            yield pd.DataFrame({"lang": lang, "source": source, "term": list(counts), "n": list(counts.values()), "d": list(map(held.__getitem__, counts))}).astype({"n": "int64", "d": "int64"})
        times.clear()
        docs.clear()

    for batch in batches:
        for text, *group in zip(batch["text"], batch["lang"], batch["source"], strict=True):
            key, seen = tuple(group), set()
            counts = times.setdefault(key, Counter())
            for terms in terms_of(text):
                counts.update(terms)
                seen.update(terms)
            docs.setdefault(key, Counter()).update(seen)
        if sum(map(len, times.values())) >= HELD:
            yield from rows()
    yield from rows()


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact beyond 64 bits of the product."""
    exact = lambda x: x.cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", exact(count + 2) * F.lit(SCALE), exact(total + 2 * terms))


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: distances of each source to the others of its language, and its `top` terms over the language's share."""
    small_batches(docs.sparkSession)
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    base = docs.select(known("text"), known("lang"), known("source"))
    groups = materialize(base.select("lang", "source").distinct(), "groups")
    counts = base.mapInPandas(_counted, "lang string, source string, term binary, n long, d long")
    counts = counts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    small = groups.count() <= MAX_GROUPS
    sent = F.broadcast if small else lambda x: x

    # places of sources in the arrays of a language follow their names
    places = groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    pairs_of = F.struct("place", "n")
    placed = counts.join(sent(places.select(F.col("lang").alias("pl"), F.col("source").alias("ps"), "place")), (F.col("lang") == F.col("pl")) & (F.col("source") == F.col("ps")))
    terms = placed.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("total"), F.collect_list(pairs_of).alias("held")).where(F.col("d") >= min_docs)
    terms = materialize(terms.select("lang", "term", "total", "held"), "terms")

    sums = terms.select("lang", F.explode("held").alias("x")).groupBy("lang", F.col("x.place").alias("place")).agg(F.sum("x.n").alias("sum"))
    vocab = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("all"))
    each = places.join(sums.withColumnsRenamed({"lang": "sl", "place": "sp"}), (F.col("lang") == F.col("sl")) & (F.col("place") == F.col("sp")), "left")
    langs = each.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "source", F.coalesce("sum", F.lit(0)).alias("sum")))).alias("x"))
    langs = langs.select("lang", F.col("x.source").alias("sources"), F.col("x.sum").alias("sums")).join(vocab.withColumnRenamed("lang", "vl"), F.col("lang") == F.col("vl"), "left")
    langs = materialize(langs.select(F.col("lang").alias("k"), "sources", "sums", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("all", F.lit(0)).alias("all")), "langs")

    # wide rows: counts and shares by place; what a source without the term has is the same for all such terms
    wide = terms.join(sent(langs.drop("sources")), F.col("lang") == F.col("k"))
    held = F.map_from_entries("held")
    wide = wide.withColumn("counts", F.transform(F.sequence(F.lit(0), F.size("sums") - 1), lambda i: F.coalesce(F.try_element_at(held, i), F.lit(0).cast("long"))))
    wide = wide.withColumn("p", F.zip_with("counts", "sums", lambda c, n: share(c, n, F.col("v")))).withColumn("q", share(F.col("total"), F.col("all"), F.col("v")))
    wide = materialize(wide.select("lang", "term", "counts", "p", "q"), "wide")

    # equal shares make a row of zeros for each language, so pairs without any kept term are there too
    rows = wide.select("lang", "p").union(langs.select(F.col("k"), F.transform("sums", lambda _: F.lit(1).cast("long"))))
    first = rows.where(F.size("p") > 1).select("lang", "p", F.explode(F.sequence(F.lit(0), F.size("p") - 2)).alias("a"))
    added = F.transform(F.sequence(F.col("a") + 1, F.size("p") - 1), lambda b: F.struct(b.alias("b"), distance(F.get("p", F.col("a")), F.get("p", b)).alias("f")))
    sums = first.select("lang", "a", F.explode(added).alias("x")).select("lang", "a", "x.b", "x.f").groupBy("lang", "a", "b").agg(F.sum("f").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("other")), F.struct(F.col("b").alias("own"), F.col("a").alias("other")))).alias("x"), "value")
    names = sent(langs.select("k", "sources"))
    pair = both.join(names, F.col("lang") == F.col("k")).select("lang", F.get("sources", F.col("x.own")).alias("source"), F.lit("pair").alias("part"), F.get("sources", F.col("x.other")).alias("item"), "value")

    over = wide.select("lang", "term", "q", F.explode(F.arrays_zip(F.col("counts"), F.col("p"), F.sequence(F.lit(0), F.size("p") - 1).alias("place"))).alias("x")).where("x.counts > 0 and x.p > q")
    over = over.select("lang", F.col("x.place").alias("place"), "term", distance(F.col("x.p"), F.col("q")).alias("value"))
    by_rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("value").desc(), "item"))
    ranked = over.withColumnRenamed("term", "item").withColumn("rank", by_rank("lang", "place")).where(F.col("rank") <= top)
    term = ranked.join(names, F.col("lang") == F.col("k")).select("lang", F.get("sources", F.col("place")).alias("source"), F.lit("term").alias("part"), "item", "value", "rank")
    return pair.withColumn("rank", by_rank("lang", "source")).union(term).select("lang", "source", "part", "item", F.col("value").cast("long"), F.col("rank").cast("int"))
