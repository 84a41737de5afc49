"""Rows that every operator must take: nulls, empty and long texts, repeats, clashing and extra columns."""

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(r: random.Random, n: int, words=("the", "of", "and", "river", "stone", "green", "walks", "under", "seven", "lamps")) -> str:
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    r = random.Random(3)
    long = sentence(r, 30_000)
    twin = "One two three four five six seven eight nine ten eleven twelve. " + sentence(r, 80)
    return [
        (1, twin, "en", "a", 1),
        (2, twin, "en", "a", 1),
        (2, twin, "en", "a", 1),
        (None, twin, None, None, None),
        (3, None, "en", "a", None),
        (4, "", None, "b", 0),
        (5, " \t\n", "en", None, 3),
        (6, long, "de", "b", 1),
        (7, "ÄÖ éè 中文 \U0001f600 1234 --", "de", "c", 1),
        (8, "word " * 5000, "en", "c", 1),
        (-9, "x", "en", "c", 1),
        (None, None, None, None, None),
    ]


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3)


@pytest.fixture
def clashing(odd):
    """The rows with columns named like the operators' own, and like `text` but for case."""
    from pyspark.sql import functions as F

    return odd.select("*", F.lit(1).alias("Text"), F.lit("v").alias("_verdict"), F.lit(2.0).alias("score"), F.lit("p").alias("fp"), F.lit(0).alias("n_words"))


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)
