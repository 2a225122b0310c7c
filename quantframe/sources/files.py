"""File scans and sinks: Parquet, CSV, JSON, text and pages, with declared schemas."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.expr import col


def write_years(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per year, sorted by ticker within files so that row groups prune by ticker."""
    years = bars.withColumn("year", F.year("date"))
    years.repartition("year").sortWithinPartitions("year", "ticker", "date").write.mode(mode).partitionBy("year").parquet(path)


def append_days(new: DataFrame, table: DataFrame, path: str) -> DataFrame:
    """Rows of new days only, in the table's columns and types, appended to its year folders; what they were."""
    last = table.agg(F.max("date").alias("__last"))
    fresh = new.crossJoin(F.broadcast(last)).where(F.col("__last").isNull() | (F.col("date") > F.col("__last")))
    fresh = fresh.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema if f.name != "year"])
    write_years(fresh, path, "append")
    return fresh


def merge_keep_last(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Union in which the new row of a key wins."""
    both = old.withColumn("__p", F.lit(1)).unionByName(new.withColumn("__p", F.lit(0)))
    w = Window.partitionBy(*key).orderBy("__p")
    return both.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__p", "__k")


def read_series_csv(spark: SparkSession, path: str) -> DataFrame:
    """date,value lines in which a dot is no value."""
    return spark.read.csv(path, header=True, schema="date date, value double", nullValue=".")


def zip_filings(submissions: DataFrame) -> DataFrame:
    """Parallel arrays (cik, form, items, accession, accepted) as rows; results filings only."""
    z = submissions.select("cik", F.explode(F.arrays_zip("form", "items", "accession", "accepted")).alias("z")).select("cik", "z.*")
    return z.where("form = '8-K' and items like '%2.02%'")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def _html_text(pages: pa.Array) -> pa.Array:
    """Texts of a batch of pages, of which a few at a time are Python strings."""

    def one(page: str | None) -> str | None:
        if page is None:
            return None
        p = _Text()
        p.feed(page)
        p.close()
        return re.sub(r"[\s\u200b]+", " ", " ".join(p.parts)).strip()

    few = [pa.array([one(x.as_py()) for x in pages[k : k + 64]], pa.string()) for k in range(0, len(pages), 64)]
    return pa.concat_arrays(few) if few else pa.array([], pa.string())


def html_text(html: str | Column, most: int | None = None) -> Column:
    """Visible text of a page, white space and zero-width spaces collapsed; whole, unless a feature gives its limit of characters."""
    text = F.arrow_udf(_html_text, StringType())(col(html))
    return F.substring(text, 1, most) if most else text


def first_exhibit(headers: str | Column) -> Column:
    """File name of the first EX-99 exhibit that a filing's index headers list, as text or as a page; NULL where there is none.

    A header lists its documents one after another, each with its type and then its file name, a tag and a token.
    """
    tag = lambda name: f"(?:<|&lt;){name}(?:>|&gt;)"
    token = lambda text: F.try_element_at(F.split(F.ltrim(text), r"[\s<&]"), F.lit(1))
    listed = F.slice(F.split(col(headers), tag("TYPE")), F.lit(2), F.lit(1_000_000))
    documents = F.transform(listed, lambda x: F.struct(token(x).alias("kind"), token(F.try_element_at(F.split(x, tag("FILENAME")), F.lit(2))).alias("name")))
    return F.try_element_at(F.filter(documents, lambda x: F.upper(x["kind"]).startswith("EX-99") & (x["name"] != "")), F.lit(1))["name"]


def sample_names(names: DataFrame, column: str, most: int = 400, seed: int = 20240521) -> DataFrame:
    """The same `most` distinct names on every run, by seeded hash; all of them where `most` is 0."""
    all_ = names.select(column).distinct()
    return all_.orderBy(F.xxhash64(column, F.lit(seed)), column).limit(most) if most else all_


def missing_parts(cache: DataFrame, whole: DataFrame, key: str, part: str) -> DataFrame:
    """(key, part): parts of the whole that a key's cache lacks; keys without any are not known here.

    Each key's parts are one set, and what it lacks is the difference to the set of all parts, which is as large as a calendar.
    """
    need = whole.agg(F.collect_set(part).alias("need"))
    have = cache.groupBy(key).agg(F.collect_set(part).alias("have"))
    return have.crossJoin(F.broadcast(need)).select(key, F.explode(F.array_except("need", "have")).alias(part))


def score_requests(events: DataFrame, model: str = "model", most: int = 1500) -> DataFrame:
    """JSONL requests (ticker, date, body -> line) with an id of ticker and date, and an estimate of tokens."""
    body = F.substring("body", 1, most)
    line = F.to_json(F.struct(F.concat_ws("|", "ticker", F.col("date").cast("string")).alias("custom_id"), F.struct(F.lit(model).alias("model"), body.alias("text")).alias("params")))
    return events.select("ticker", "date", line.alias("line"), (F.length(body) / 4).alias("tokens"))


def parse_scores(lines: DataFrame) -> DataFrame:
    """Responses (custom_id, content) as ticker, date, score in -5..5 and guidance; malformed content gives NULLs."""
    part = F.split("custom_id", r"\|")
    raw = F.expr("try_cast(get_json_object(content, '$.score') as double)")
    g = F.lower(F.get_json_object("content", "$.guidance"))
    return lines.select(part[0].alias("ticker"), F.to_date(part[1]).alias("date"), F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(-5.0)), F.lit(5.0))).alias("score"), F.when(g.isin("raised", "lowered", "maintained"), g).otherwise("none").alias("guidance"))


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Hand whole texts to Python in Arrow batches of at most `size` bytes, unless the user has set another size than Spark's own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(64 << 20):
        spark.conf.set(key, str(size))


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the one that all executors share (spark.checkpoint.dir); of this machine only where that is unset."""
    import tempfile
    import uuid

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.quantframe.work", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quantframe-")
        spark.conf.set("spark.quantframe.work", base)
    return f"{base.rstrip('/')}/quantframe/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table under work_dir and read back: cuts the lineage, so a lost executor repeats no earlier stage."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
