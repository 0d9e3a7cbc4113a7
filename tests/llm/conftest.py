import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and extra columns whose names clash with outputs."""
    long = "word " * 30_000
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 3.0, "x"), (1, "alpha beta gamma delta epsilon zeta", "en", "a", 3.0, "x"),
        (2, None, None, None, None, None), (3, "", "en", "", 0.0, "y"), (4, "   \n\t ", "de", "b", None, None), (5, long, "en", "a", 1.0, "z"),
        (6, long, "fr", "b", 1.0, "z"), (7, "Alpha beta gamma delta epsilon zeta", None, "c", 2.0, "q"), (None, "no id here", "en", "a", 1.0, "z"),
        (8, "éà 😀 12 <|endoftext|> mail a@b.co.uk", "fr", "c", 1.0, "t"), (9, "one", "en", "a", 1.0, "u"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, predicted string")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, 1 - i % 2) for i in range(1, 10)] + [(1, None, None), (None, 1, 1), (5, 0, 1), (99, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)
