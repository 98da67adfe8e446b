import pytest

AWKWARD = [
    (5, "one two three four five six seven", "x"), (1, None, "x"), (2, "", None), (9, "   \n\t", "y"), (4, "Ünïcode 漢字 🙂 <|endoftext|> 'll", "x"),
    (7, "one two three four five six seven", "z"), (5, "one two three four five six seven", "x"), (None, "no number here at all", "x"), (11, "word " * 30000, "x"), (12, "a", "x"),
]
COLUMNS = "doc_id long, text string, source string, score double, n_links long, `key` string, h string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with results."""
    return spark.createDataFrame([(*r, 0.5, 1, "k", "h") for r in AWKWARD], COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
