import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names the operators use themselves.
CLASH = [
    "score", "predicted", "shard", "slot", "copy", "spans", "items", "n_words", "kept", "lang_pred", "node", "block", "size",
    "parts", "cdf", "rate", "_own", "_id", "_text", "_hash", "_source", "_count",
]


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and clashing columns."""
    from pyspark.sql import functions as F

    rng = random.Random(3)
    long_text = words(rng, 30_000)
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the old stone bridge at noon today.", "en", "a", 80),
        (1, "The quick brown fox jumps over the lazy dog near the old stone bridge at noon today.", "en", "a", 80),
        (2, None, "en", "a", None), (3, "", None, "b", 0), (4, " \n\t ", "de", None, 4),
        (5, long_text, "en", "b", len(long_text)), (6, long_text + " end", "en", "b", 1), (7, "ü" * 300, "de", "b", 300),
        (None, "the QUICK brown fox jumps over the lazy dog near the old stone bridge", None, None, None),
        (None, None, None, None, None), (8, "####", "fr", "c", 4), (9, "a", "fr", "c", 1), (-5, "a", "fr", "c", 1),
        (10, "The quick brown fox jumps over the lazy dog near the old stone bridge at noon today.", "en", "a", 80),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some_labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (1, 1, 0), (3, 0, 0), (5, 1, 0), (8, 0, 0), (9, None, None), (None, 1, 0), (77, 0, 1)],
        "doc_id long, quality int, toxic int",
    )
