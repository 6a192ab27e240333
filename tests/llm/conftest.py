import pytest

LONG = " ".join(f"word{i % 977} and" for i in range(60_000))
TEXT = "the quick brown fox jumps over the lazy dog and runs away from the old barn near the river at night"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns named like the operators' own."""
    rows = [
        (1, TEXT, "en", "a", 10, 7, "x"),
        (1, TEXT, "en", "a", 10, 7, "x"),
        (2, TEXT.upper(), None, None, None, None, None),
        (3, None, "en", "a", 0, 0, ""),
        (4, "", "en", "a", 0, 0, ""),
        (5, "one", "de", "b", 3, 1, ""),
        (6, " \t\n", "de", "b", 3, 1, ""),
        (7, LONG, "de", "b", 10**6, 1, ""),
        (8, LONG + " tail", "de", "b", 10**6, 1, ""),
        (9, "123 456 !!! ???", "fr", "c", 15, 1, ""),
        (None, TEXT, "en", "a", 10, 7, "x"),
        (None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, key string").selectExpr("*", "n as size", "key as seed", "n as id", "n as shard", "key as words", "n as score", "key as label", "n as at", "n as component")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")
