import pytest

LONG = " ".join(f"word{i % 977} und{i % 13}" for i in range(9000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and columns that clash with added ones."""
    rows = [
        (1, "The cat sat on the mat. " * 3 + "It was fine and warm in the house today.", "en", "a", "x"),
        (1, "The cat sat on the mat. " * 3 + "It was fine and warm in the house today.", "en", "a", "x"),
        (2, None, None, None, "x"), (3, "", "de", "b", "x"), (4, LONG, "en", "a", "x"), (None, "no id here", "en", None, "x"),
        (5, " \t\n ", "fr", "a", None), (6, "ünï çödé\nline | two | three ### !!", "fr", "c", "x"), (7, LONG, "en", "a", "x"),
    ]
    return spark.createDataFrame([(*r[:4], len(r[1] or ""), r[4], r[4]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, host string, kept string")


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def real(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
