import pytest


@pytest.fixture()
def docs(spark):
    """Rows with nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, "one line", "a"), (1, "one line", "a"), (2, None, "a"), (3, "", None), (None, "no id here", "b"), (4, long, "b"), (5, "  \n \n", "a"), (6, "é ü 💡 # $ %", "c")]
    return spark.createDataFrame([(*r, i, "x", i, 0.5) for i, r in enumerate(rows)], "doc_id long, text string, source string, n long, h string, count long, weight double")


@pytest.fixture()
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, n long")
