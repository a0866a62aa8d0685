"""Small tables with the cases every operator has to take: nulls, empty and long texts, ties, repeats, odd columns."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
_LETTERS = str.maketrans("0123456789", "ghijklmnop")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return SPLIT.findall(text or "")


def prose(rng: random.Random, n: int, vocabulary: int = 3000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary):x}".translate(_LETTERS) for _ in range(n))


def documents(spark: SparkSession, texts: list[tuple[int | None, str | None]]) -> DataFrame:
    rows = [(i, t, None if k % 3 else "en", "src0", None if t is None else len(t)) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def odd_texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    """Distinct ids but for one repeated row; one row without id."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    edited = base.split()
    edited[60] = "other"
    passage = prose(rng, 70)
    return [
        (1, base), (2, base), (3, " ".join(edited)), (4, None), (5, ""), (6, " \t\n "), (7, "one two"),
        (8, prose(rng, 30) + " " + passage + "\n" + prose(rng, 25)), (9, prose(rng, 10) + "\t" + passage + " " + prose(rng, 40)),
        (10, prose(rng, 6000)), (11, "x" * 5000), (12, "spam spam spam " * 80), (13, "A line.\nA line.\nB\n\n" * 30),
        (14, "été 日本語 ﬁ # * $ % & | < > 123"), (15, base), (15, base), (None, prose(rng, 80)), (16, passage),
    ]


def odd_documents(spark: SparkSession) -> DataFrame:
    return documents(spark, odd_texts())


def empty_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOC_SCHEMA)
