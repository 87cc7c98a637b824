"""Small documents with every odd case."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, row string, id string"


@pytest.fixture(scope="session")
def odd_rows():
    """Null in each column, empty, blank and very long texts, repeated rows, and columns with clashing names."""
    long_text = "Once more the river ran on. " * 3000
    para = "First line of a passage.\nSecond line of it here.\nThird line that follows.\nFourth line to end it.\n"
    rows = [
        (1, "The cat sat on the mat. It was warm.", "en", "b", 36),
        (1, "The cat sat on the mat. It was warm.", "en", "b", 36),
        (2, None, "en", "a", None),
        (3, "", None, "a", 0),
        (4, " \n\t ", "de", None, 4),
        (None, "No id here but words.", "en", "b", 21),
        (5, long_text, "en", "b", len(long_text)),
        (6, "äöü ß 漢字 🙂 word", "de", "", 16),
        (7, "alpha. " + para + "omega.", "en", "c", 100),
        (8, "beta beta. " + para + "other end here.", "en", "c", 100),
        (9, "12345 !!! ...", "en", "a", 13),
    ]
    return [(*r, "x", "y", "z", "w") for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
