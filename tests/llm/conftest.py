import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns of clashing names."""
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(["the", "loom", "weaves", "grey", "cloth", "at", "dawn", "über", "naïve"]) + rng.choice(["", "", ".", ","]) for _ in range(n))
    shared = prose(120)
    rows = [
        (1, "", "en", "a", 0, "x", 7),
        (2, None, None, None, None, None, None),
        (None, prose(30), "en", "a", 5, "x", 7),
        (3, shared, "en", "b", 5, "y", 7),
        (4, shared, "en", "b", 5, "y", 7),
        (4, shared, "en", "b", 5, "y", 7),
        (5, prose(10) + " " + shared + " " + prose(9), "de", "c", 5, "y", 7),
        (6, prose(6000), "en", "a", 5, None, 7),
        (6, "another text under the same id", "en", "a", 5, None, 7),
        (7, "  \n\t ", "en", "c", 5, None, 7),
        (8, "x" * 3000, "en", "c", 5, None, 7),
        (9, "\U0001f9f5 " * 500, "en", "c", 5, None, 7),
    ]
    return spark.createDataFrame(rows, DOCUMENTS + ", size string, kept int").repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
