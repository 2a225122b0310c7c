"""Corpus cleaning pipeline: STAGES in order, each over all that its predecessor kept.

Every stage but the last is written to the shared folder and read again, so a lost executor repeats one stage at most.
Nulls, empty texts, ties, repeated rows, empty tables and extra columns are handled as quantframe.llm.stages states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantframe.llm import stages
from quantframe.llm.common import documents, materialize

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line_dedup", stages.drop_lines),
    ("near_dedup", stages.drop_near_duplicates),
    ("decontamination", stages.drop_leaks),
    ("packing", stages.pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
