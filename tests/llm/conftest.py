import pytest

#: Texts of every odd kind.
LONG = " ".join(f"word{i % 700}" for i in range(60_000))
ODD = [
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "s", 10),
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "s", 10),  # a repeated row
    (2, None, "en", "s", None),
    (3, "", None, "s", 0),
    (4, " \t\n ", "fr", None, 4),
    (None, "A text whose id is null, with some words to keep it company here.", "en", "s", 3),
    (None, None, None, None, None),
    (5, LONG, "de", "s", len(LONG)),
    (6, "é日本語 ✓ no\u00a0break <|endoftext|> 12,5 %\r\nnext\x0bline", "es", "s", 30),
    (7, "a\n\n\nb\n \nc", "en", "s", 8),
]


@pytest.fixture(scope="session")
def odd(spark):
    """documents with nulls in any column, odd texts, a repeated row, and extra columns with clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    extra = ["score", "kept", "n_words", "labels", "ids", "token", "k", "t", "n", "id", "tk", "host", "n_lines", "h", "s", "gone", "_t", "__t", "__k", "__h", "__id", "__tk", "__gone", "__text", "__url"]
    return df.select("*", *[F.lit("x").alias(c) for c in extra]).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0).cache()


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").cache()


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
