import pytest

LONG = "word " * 60_000 + "end"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns that operators use themselves."""
    rows = [(0, None), (1, ""), (2, " \t\n\r\f\v "), (3, "one"), (4, "one two three four"), (5, LONG), (6, "tie " * 80), (7, "tie " * 80),
            (8, "same row " * 40), (8, "same row " * 40), (None, "no id " * 60), (9, "ÄÖ é 漢字 \U0001F600 x" * 30),
            (10, "\x00\x7f a\x1cb <|endoftext|> 's" * 20), (11, "Alpha beta gamma. " * 40 + "\n" + "delta " * 40)]
    full = [(i, t, None if k % 3 else "en", "src", None if t is None else len(t), 1, "x", 2.0, True)
            for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, node string, "
                                       "score double, kept boolean")


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, 0, 1), (4, 1, 0), (5, 1, 0), (6, 1, 1), (None, 1, 1), (8, None, None), (8, 1, 0), (99, 0, 1),
                                  (11, 0, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet").cache()
