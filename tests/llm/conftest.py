import pytest

#: Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash.
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 70, "x", 1, "y"),
    (2, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 70, "x", 1, "y"),
    (3, None, None, None, None, None, None, None),
    (4, "", "en", "", 0, "", 0, ""),
    (5, "word " * 30_000, "en", "b", 150_000, "x", 2, "y"),
    (6, "\n\n  \t", "de", "b", 4, "x", 2, "y"),
    (7, "Füße über Straßen\nthe end\nthe end\nThe  END", "de", "b", 30, "x", 2, "y"),
    (7, "Füße über Straßen\nthe end\nthe end\nThe  END", "de", "b", 30, "x", 2, "y"),
    (None, "no id here, but some words follow", "en", "c", 20, "x", 2, "y"),
    (8, "😀😀 日本語 ▁ <|endoftext|> </s> \x00", "fr", "c", 20, "x", 2, "y"),
    (9, "x" * 3000, "fr", "c", 3000, "x", 2, "y"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, Text string, fp bigint, DOC_ID string"


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(TEXTS, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
