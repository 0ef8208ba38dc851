import pytest

DOCS = "doc_id bigint, text string, extra string, n_words bigint"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, a clashing column name."""
    long_text = " ".join(f"word{k % 977} tail{k % 13}" for k in range(6000))
    rows = [(1, None, "x", 5), (2, "", None, None), (None, "some words without an id here now", "y", 1), (3, " \n\t ", "x", 0),
            (4, long_text, "z", 9), (4, long_text, "z", 9), (5, long_text, "z", 9), (6, "é" * 3000, "z", 9), (7, "one two", None, 2)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
