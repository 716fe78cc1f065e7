import random

import pytest

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("slot", T.StringType()), T.StructField("row", T.StringType())]
)


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(["an", "or", "the", "ti", "on", "re", "sh", "é", "ing"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, exact and near copies, columns with clashing names."""
    rng = random.Random(7)
    base = words(rng, 120)
    rows = [
        (1, None, "en", "a", 0, "x", "y"),
        (2, "", "en", "a", 0, "x", "y"),
        (3, "   \n\t ", "en", None, 6, None, None),
        (None, "a text without an id", None, "b", 20, "x", "y"),
        (4, "short", "en", "b", 5, "x", "y"),
        (5, " ".join(base), "en", "a", 1, "x", "y"),
        (6, " ".join(base), "en", "b", 1, "x", "y"),
        (7, " ".join(base[:60] + ["changed"] + base[61:]), "en", "b", 1, "x", "y"),
        (8, " ".join(words(rng, 120)), "de", "b", 1, "x", "y"),
        (9, " ".join(words(rng, 30_000)), "fr", "c", 1, "x", "y"),
        (9, "another text of the same id", "fr", "c", 1, "x", "y"),
        (10, "repeated row <|endoftext|> here", "fr", "c", 1, "x", "y"),
        (10, "repeated row <|endoftext|> here", "fr", "c", 1, "x", "y"),
        (11, "Is it  two   blanks\n\nand\tthe rest? the of and to in a", "es", "c", 1, "x", "y"),
    ]
    return rows + [(100 + i, " ".join(words(rng, rng.randint(1, 200))), "en", rng.choice(["a", "a", "a", "b", "c"]), 1, "x", "y") for i in range(60)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCUMENTS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)
