import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows an operator must live with: nulls everywhere, empty, blank, repeated and very long texts, extra columns."""
    long = "Lorem ipsum dolor sit amet, consetetur. " * 6000
    rows = [(1, "a plain text of some words, nothing more to it at all", "x", None, 1), (2, None, None, None, None), (3, "", "x", 2.0, 2), (4, " \t\n ", "x", 2.0, 2),
            (5, "word", None, 1.0, 3), (6, long, "y", 1.0, 3), (7, long + "end", "y", 1.0, 3), (None, "no id", "y", 1.0, 3), (1, "a plain text of some words, nothing more to it at all", "x", None, 1),
            (9, "é́ ﬁ \U0001F600 <|endoftext|> tail\0nul", "z", 0.0, 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, rank string, score double, chunk int")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def some_documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
