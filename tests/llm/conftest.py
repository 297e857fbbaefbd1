import pytest

#: Column names that operators use inside; as extra columns they must not get in the way.
CLASHING = ["h", "row", "kept", "again", "words", "id", "sha", "n", "lang", "source", "band", "hits", "places", "item", "shard", "slot", "score", "trusted", "class_id", "text_sha256"]
ODD = [(1, "a b c d e f"), (2, None), (3, ""), (4, "a b c d e f"), (4, "a b c d e f"), (None, "no id"), (None, None), (5, "  \n\n x"), (6, "word " * 40_000), (7, "é漢🙂 <|im_end|>"), (8, "A" * 100_000)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit(c) for c in CLASHING})
    return df.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en")).withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit("s")))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
