import pytest

#: Rows that every document operator must take: null and empty texts, white space, ties, repeats, a long text.
ODD = [
    (5, None),
    (1, ""),
    (2, " \n\t "),
    (3, "one"),
    (4, "the same words stand here twice over and over again"),
    (9, "the same words stand here twice over and over again"),
    (9, "the same words stand here twice over and over again"),
    (None, "no id has this text of a few words"),
    (7, "Ünï cödé 日本語 😀 don't <|endoftext|> x"),
    (8, "long text of many words, " * 3000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The rows with clashing names in extra columns."""
    rows = [(i, t, None, "src", None, 1, 2, "x") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, n int, hash string").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
