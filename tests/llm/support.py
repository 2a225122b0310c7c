"""Small tables for the text operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in ("ba", "ke", "li", "mo", "ru") for b in ("n", "st", "r") for c in ("a", "elo", "im", "us")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def odd_texts(rng: random.Random) -> list[str | None]:
    """Nulls, empties, blanks, ties, repeats, one very long text."""
    a, long = prose(rng, 60), prose(rng, 4000)
    return [None, "", " \n\t ", "x", a, a, a.upper(), a + " more words here", long, long[:9000], "é" * 50 + "\n" + "中文 " * 30, "same line of some length here\n" * 5, "same line of some length here", "same line of some length here\nother"]
