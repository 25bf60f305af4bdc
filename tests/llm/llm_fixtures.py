import random

import pytest

@pytest.fixture(scope="session")
def odd_rows():
    """Documents with every awkward case: nulls in each column, empty and blank texts, a very long text, ties, repeated
    rows and ids, and non-ASCII text."""
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("lor", "am", "dol", "sit", "vel", "ex") for b in ("em", "ora", "is", "unt", "é")]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n)) + "."

    base = prose(60)
    rows = [
        (1, base, "en", "s1", 10), (2, base, "en", "s1", 10), (3, base + " extra", "en", "s2", None),
        (4, None, None, None, None), (5, "", "fr", "s1", 0), (6, " \n\t ", "fr", "s1", 4), (7, prose(3), "fr", None, 5),
        (8, prose(20000), "fr", "s1", 9), (None, prose(30), "en", "s3", 9), (10, "12345 !!! ---", "de", "s3", 3),
        (11, prose(50), "en", "s1", 1), (11, prose(50), "en", "s1", 1), (12, "naïve café\nline two. Third?", "fr", "s2", 1),
    ]
    rows.append(rows[10])  # a repeated row
    return rows


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOC_SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def clashing_docs(odd_docs):
    """The same documents with extra columns whose names clash with those that operators make."""
    from pyspark.sql import functions as F
    return odd_docs.select("*", *[F.lit("x").alias(c) for c in (
        "bin", "ids", "score", "selected", "gram", "n", "class", "key", "bucket", "next", "digest", "size", "letters")])
