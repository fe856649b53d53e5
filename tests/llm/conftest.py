import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, H string, rate string, keep string, Level0 string, t string"
LONG = "lorem ipsum dolor " * 20_000


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns named like internal ones."""
    base = "one two three four five six seven eight nine ten " * 8
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base + "more", None, "b", None), (None, base, "de", None, 2), (4, None, "en", "a", None),
        (5, "", "en", "b", 0), (6, "   \n\t ", "fr", "b", 5), (7, LONG, "en", "c", len(LONG)), (8, LONG, "en", "c", len(LONG)), (9, "x", "en", "a", 1), (9, "y z", "de", "b", 3),
        (None, None, None, None, None), (10, "Ünï cödé wörds und mehr, täglich.\nZweite Zeile!", "de", "c", 40), (11, "", "en", "a", 0), (12, "a" * 100_000, "en", "c", 100_000),
    ]
    return spark.createDataFrame([(*r, "h", None, "k", "l", "t") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(messy):
    return messy.where("false")


def words(text):
    import re

    return [w for w in re.split(rb"[\x00-\x20]+", text.encode().lower()) if w]
