import random

import pytest

EDGE = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, fp int, key int, spans string, `a.b` int, word string"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty, blank and very long texts, repeated ids and rows, columns with clashing names."""
    rng = random.Random(7)
    long = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(40_000))
    rest = ("en", "s", 1, "x", 2, 3, "y", 4, "z")
    rows = [(None, "alpha beta gamma delta", *rest), (1, None, *rest), (2, "", *rest), (3, " \t\n ", *rest), (4, long, *rest),
            (5, "one two three four five", *rest), (5, "one two three four five", *rest), (5, "another text of one id", *rest),
            (6, "é ñ 中 😀 \x00 ﬁ", *[None] * 9), (None, None, *[None] * 9), (7, "x" * 50_000, *rest)]
    return spark.createDataFrame(rows, EDGE).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], EDGE)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
