import pytest

#: Nulls in every column, empty and long texts, ties, repeated rows.
LONG = " ".join(f"word{i}" for i in range(30_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again today", "en", "a", 10),
    (2, "the quick brown fox jumps over the lazy dog again and again today", "en", "a", 10),
    (2, "the quick brown fox jumps over the lazy dog again and again today", "en", "a", 10),
    (3, "", "en", "b", 0),
    (4, None, None, None, None),
    (None, "no id here but some words in a row to be read as text", "en", "b", 5),
    (5, "   \t\n ", "de", "b", 5),
    (6, LONG, "en", "c", len(LONG)),
    (7, "ein", "de", None, 3),
    (8, "É à ü ß 漢字 mixed Ünïcode wörds", "de", "c", 20),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def rows():
    return ROWS


@pytest.fixture(scope="session")
def docs(spark):
    """The edge cases with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA)
    extra = ["id", "size", "key", "fingerprint", "score", "row", "node", "tie", "cell", "label", "spans", "host", "path"]
    return df.withColumns({c: F.lit(f"extra {c}") for c in extra})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark, data):
    return [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
