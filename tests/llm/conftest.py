import pytest

#: Odd rows of a documents table: nulls in every column, empty, blank, repeated and long texts, ties.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "src0", 10),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "src0", 10),
    (3, None, None, None, None),
    (4, "", "en", "src1", 0),
    (5, "   \n\t ", "en", "src1", 6),
    (6, "one", "de", "src2", 3),
    (7, "lorem ipsum dolor " * 4000, "en", "src2", 68000),
    (None, "an id that is null", "en", "src3", 18),
    (8, "same id twice", "en", "src3", 13),
    (8, "same id twice", "en", "src3", 13),
    (8, "same id, another text", "en", "src3", 21),
    (9, "émigré 日本語 😀 naïve text", "fr", "src4", 22),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns with names that operators might use inside."""
    from pyspark.sql import functions as F

    out = odd
    for name in ("_row", "_scan", "_text", "fingerprint", "node", "cell", "_quality", "spans", "start", "score", "id"):
        out = out.withColumn(name, F.lit("x"))
    return out


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
