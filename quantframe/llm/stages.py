"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of docs.

Each stage takes docs with the columns of `documents` (others pass through, whatever their names) and works on all
rows given. Defined cases of all stages: a null or empty text is never toxic, holds one empty line, is near nothing and
leaks nothing, so it is kept and packed as its end id; a row with a null doc_id is kept (as one document for line
dedup, as no part of any group of near-duplicates); repeated rows are judged alike, and of repeated rows near_dedup
keeps one doc_id with all its rows; an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, line_dedup, minhash, packing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic (p_toxic < 0.5), by a model of the labelled ones among them; without labels of both kinds all stay."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that three or more documents share (the largest doc_id keeps them); n_chars follows the text, which may become empty."""
    return line_dedup.dedup_lines(docs, counts=False).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near-duplicates: five words a shingle, similarity 0.8 or more."""
    return minhash.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item at half its full alignment score or more; without items all stay."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences: each id of each document in exactly one piece."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), {"<|endoftext|>": 50256})
