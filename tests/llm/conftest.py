from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in all columns, empty and blank texts, a very long text, repeats, and clashing names."""
    long = " ".join(f"w{i % 977} x{i % 131}." for i in range(60_000))
    rows = [
        (1, "A plain sentence about the weather in the north, and some more words here.", "en", "a", 10, "x"),
        (2, None, "en", "a", None, "x"),
        (3, "", None, None, 0, None),
        (4, " \n\t \x0b\x0c\r ", "de", "b", 9, "x"),
        (5, long, "en", "b", len(long), "x"),
        (6, "Same text in two rows with more than five words.", "en", "c", 1, "x"),
        (7, "Same text in two rows with more than five words.", "en", "c", 1, "x"),
        (7, "Same text in two rows with more than five words.", "en", "c", 1, "x"),
        (None, "A text without any id, long enough for a shingle or two.", "fr", "c", 1, "x"),
        (8, "é ü ß 漢字 😀", "xx", "d", 1, "x"),
        (9, "one", "en", "d", 1, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies string")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")
