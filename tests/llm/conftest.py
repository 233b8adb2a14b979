import pytest

EDGE = [
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "src0", 60),
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "src0", 60),
    (2, "the QUICK brown fox\njumps over the lazy dog again and again.", None, None, None),
    (3, None, "en", "src1", 0),
    (4, "", None, "src2", 0),
    (None, "a row without an id, with some words in it", "de", "src0", 1),
    (5, "wort " * 30_000, "de", "src3", 1),
    (6, "x" * 200_000, "xx", "src3", 1),
    (7, "é ü 日本語 😀 \t\n", "ja", "", 1),
    (8, "%%% ### 12345", "en", "src0", 1),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, repeated rows; extra columns with clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGE, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in ("score", "id", "node", "key", "start", "fingerprint", "row", "domain", "n_tokens")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
