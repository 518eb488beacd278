import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and an extra column with a clashing name."""
    words = [f"word{i % 977}x{i}" for i in range(40_000)]
    rows = [
        (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 1),
        (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 1),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (None, "ein kurzer text ohne nummer", "de", "b", 5),
        (4, " ".join(words), "en", "a", 9),
        (5, "*** !!! ???", None, "b", 3),
        (6, "ok", "fr", "b", 2),
    ]
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("mine")).withColumn("label", F.lit(7)).withColumn("n", F.lit(1)).withColumn("node", F.lit("x"))


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], DOCS)
