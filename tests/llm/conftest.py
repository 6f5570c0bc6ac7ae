import random

import pytest

WORDS = "the of and river stone bright under walk seven house letter garden over quick small north water light".split()


@pytest.fixture(scope="session")
def prose():
    """Seeded sentences: prose(seed, n) has n words."""

    def make(seed, n):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ing", "s", "er"]) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Nulls in any column, empty and blank texts, a very long one, ties, repeated rows, clashing extra columns."""
    long = prose(1, 20_000)
    rows = [
        (1, prose(2, 80), "en", "a"),
        (1, prose(2, 80), "en", "a"),
        (1, prose(3, 90), "fr", "b"),
        (2, prose(2, 80), None, None),
        (3, None, "en", "a"),
        (4, "", None, "b"),
        (5, " \t\n\x0b\x0c\r ", "en", None),
        (6, long, "en", "a"),
        (None, prose(4, 70), "en", "c"),
        (None, None, None, None),
        (7, "é中\U0001f600 \x00 word", "xx", "d"),
        (8, "one two three", "en", "d"),
        (9, "no-break space and\u0085next", "en", "d"),
    ]
    extra = [(*r, 0, "k", "c", 1.0, "r", [1], "s", True, "n", -1) for r in rows]
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long, key string, content string, size double, row string, "
        "ids array<int>, spans string, kept boolean, component string, taken int"
    )
    return spark.createDataFrame(extra, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def texts_of():
    """(doc_id, text) of every row, null texts empty."""
    return lambda df: [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
