import random

import pytest
from made import words

@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties, columns with names used inside."""
    r = random.Random(3)
    base = words(r, 60)
    rows = [
        (1, " ".join(base), "en", "a", 0),
        (2, " ".join(base), "en", "a", 0),
        (2, " ".join(base), "en", "a", 0),
        (3, " ".join([*base[:58], "other", "end"]), None, None, None),
        (4, None, "en", "b", 0),
        (5, "", "en", "b", 0),
        (6, " \n\t ", None, "", 0),
        (None, "no id here at all today", "en", None, 0),
        (7, "two words", "en", "a", 0),
        (8, "two words", "en", "b", 0),
        (9, " ".join(words(r, 60_000)), "en", "c", 0),
        (10, "x" * 200_000, "en", "c", 0),
        (11, "émigré 😀 token=\"abcdefghijklmnop1234\" ▁ \x00 end", "fr", "a", 0),
    ] + [(20 + i, " ".join(words(r, 30 + i)), "en", "abc"[i % 3], 0) for i in range(30)]
    extra = [(*x, "k", 1, 1, b"p", 2) for x in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, _key string, path int, n int, tokens binary, _rows int")


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(1, 50)] + [(3, None, None), (None, 1, 1), (4, 1, 0), (4, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("label", __import__("pyspark").sql.functions.lit("x"))


@pytest.fixture(scope="session")
def no_labels(spark, odd_labels):
    return spark.createDataFrame([], odd_labels.schema)
