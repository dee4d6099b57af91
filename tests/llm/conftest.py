import random

import pytest

DOCS = "doc_id long, text string, lang string, fp long, ids string, score string, component_id string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, very long and repeated texts, extra columns with clashing names."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = " ".join(rng.choices(words, k=120))
    long = " ".join(rng.choices(words, k=60_000))
    rows = [
        (1, base, "en", 1, "a", "x", "y"), (2, base, None, None, None, None, None), (3, base + " tail", "en", 1, "a", "x", "y"),
        (4, None, "en", 1, "a", "x", "y"), (5, "", "en", 1, "a", "x", "y"), (6, " \t\n ", "en", 1, "a", "x", "y"),
        (7, long, "en", 1, "a", "x", "y"), (7, long, "en", 1, "a", "x", "y"), (None, "one two", "en", 1, "a", "x", "y"),
        (None, None, None, None, None, None, None), (8, "One", "en", 1, "a", "x", "y"), (9, "<s> é ü 中文   </s> \x1c x", "en", 1, "a", "x", "y"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
