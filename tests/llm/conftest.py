import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def folder():
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls in every column, empty and very long texts, repeats, and columns named like those the operators use."""
    long = "word " * 60_000 + "\n" + "x" * 200_000
    rows = [
        (1, "the same text of a few words here", "en", "a", 1),
        (1, "the same text of a few words here", "en", "a", 1),
        (2, "the same text of a few words here", "en", None, None),
        (None, "the same text of a few words here", None, None, None),
        (3, None, "en", "a", 0),
        (4, "", "en", "a", 0),
        (5, " \n\t \n", None, "a", 0),
        (6, long, "de", "b", 5),
        (7, "12 345 ... !!", "de", "b", 5),
        (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("size", "slot", "mark", "place", "bucket", "cls", "score", "leaf", "n_lines", "n_replaced", "packed_row", "c0", "words", "found", "new", "drop"):
        df = df.withColumn(name, F.lit(1))
    return df


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
