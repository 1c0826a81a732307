import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    long = " ".join(f"w{k * k % 977}x{k}" for k in range(30_000))
    rows = [(1, "a b c d e f g", "x", 1), (1, "a b c d e f g", "x", 1), (1, "another text of the same number", "x", 1), (2, "", "x", 2), (3, None, None, None), (None, "a b c d e f g", None, 3), (None, None, None, None), (4, long, "y", 9), (5, long + " tail", "y", 9), (6, " \t\n", "y", 9), (7, "é ñ 漢字 😀 A B", "y", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n long").selectExpr("doc_id", "text", "source", "n as cell", "n as score", "n as hash", "n as rank", "n as hits", "n as key", "n as bucket", "n as `a.b`")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, cell long")
