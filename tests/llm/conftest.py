import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def small(spark, sf_dir):
    """All documents of the smallest tables."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(small):
    return {r.doc_id: r.text for r in small.select("doc_id", "text").collect()}


# Odd rows. Nulls in each column, empty and blank texts, equal rows, marks of the tokenizer, long runs.
ODD = [
    (1, "one two three four five six seven", "en", "web", 33), (1, "one two three four five six seven", "en", "web", 33),
    (2, None, None, None, None), (3, "", "en", "web", 0), (4, " \t\n\x0b ", "de", None, 5), (5, "a", None, "books", 1), (None, "no id here", "en", "web", 10),
    (6, "Grüße an alle \U0001f600 ça va? <|endoftext|> x\x01y don't ... stop!!! ÀB̀ 1234567", "fr", "web", 60),
    (7, "word " * 30_000, "en", "code", 150_000), (8, "9" * 50_000, "en", "code", 50_000), (9, "mail me: a.b@c.de, +49 (30) 1234-5678, 10.0.0.1, 4111 1111 1111 1111", "en", "web", 70),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """odd with extra columns whose names clash with its own and with those of operators."""
    spark_case = odd.sparkSession.conf.get("spark.sql.caseSensitive")
    assert spark_case == "false"
    return odd.select("*", F.lit(1).alias("TEXT"), F.lit("x").alias("Doc_ID"), F.lit(2).alias("size"), F.lit(3).alias("fp"), F.lit(4).alias("_0"), F.lit(5).alias("Source"))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
