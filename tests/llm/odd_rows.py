"""Small tables with the odd cases that every operator must survive."""

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river bank at night"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, ties, an extra column, and names used inside operators."""
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, PROSE, "en", "a", 1), (1, PROSE, "en", "a", 1), (2, PROSE, "en", None, 1), (3, "", "en", "b", 0), (4, None, None, "b", None), (None, None, None, None, None),
            (None, PROSE + " tail", "en", "a", 1), (5, long, "en", "c", 1), (6, "two words", "en", "c", 9), (7, "two words", "en", "c", 9), (8, "\n \t\n", "en", "a", 4)]
    df = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as fp", "2 as label", "3 as score", "4 as h", "5 as size", "'x' as key")
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
SF = "/root/testdata/sf0.001"
