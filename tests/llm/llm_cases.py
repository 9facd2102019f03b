"""Inputs shared by the tests of the training-data operators; tests import the fixtures that they use."""

import pytest


SF = "/root/testdata/sf0.001"

#: Nulls, empty and odd texts, repeated rows and repeated ids, for every operator that reads documents.
ODD = [
    (1, "the cat sat on the mat and looked at the other cat on the other mat " * 4, "en", "a"),
    (2, "the cat sat on the mat and looked at the other cat on the other mat " * 4, "en", "a"),
    (2, "the cat sat on the mat and looked at the other cat on the other mat " * 4, "en", "a"),
    (3, None, "en", "b"), (4, "", None, None), (5, "   \n\t ", "fr", "b"), (6, "one", "fr", "c"),
    (7, "▁▁ x▁  y\n\nz\x00<s>☃𝄞", "xx", "c"), (8, "THE CAT sat on the Mat", "en", "a"),
    (None, "a document without an id, but with words", "en", "a"), (9, "word" * 3000, "de", "d"),
    (10, "a b " * 20000, "de", "d"), (11, "a b " * 20000 + "c", "de", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """ODD with extra columns whose names clash with those that operators use inside."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(ODD, SCHEMA)
    for c in ("block", "shard", "keys", "size", "n_tokens", "rank", "at", "key", "ids", "score", "n_chars", "component_id", "copies"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
