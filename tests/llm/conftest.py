import pytest


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and blank texts, repeated rows, one very long text, and extra columns with clashing names."""
    long = " ".join(f"w{i % 977} x{i}" for i in range(15_000))
    rows = [
        (1, "the same text twice in here", "a", "x", 0), (2, "the same text twice in here", "b", None, 1), (2, "the same text twice in here", "b", None, 1), (3, "", None, None, None),
        (4, None, None, "z", 5), (5, " \t\n ", "c", "w", 3), (6, long, "d", "v", 2), (7, long + " tail", "d", "v", 2), (None, "without an id", None, None, None), (8, "two words", "e", "u", 4),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, length string, n long")
