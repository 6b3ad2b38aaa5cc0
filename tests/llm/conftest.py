import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """The small table; its rows as (doc_id, text)."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang, source])."""
    def f(*rows):
        full = [(*r, *([None] * (4 - len(r))), len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return f


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in every column, empty and very long texts, ties and repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 977} filler{i}" for i in range(30_000))
    df = make((1, "the same words in the same order, again and again they come", "en", "a"), (1, "the same words in the same order, again and again they come", "en", "a"), (2, "", "de", "b"), (3, None, None, None), (None, "a text without an id but with more than ten words in it, so it counts", "fr", None), (4, long, "en", "a"), (5, "\n \t\n", "en", ""), (6, "é ü 漢字 \U0001f600 x", "fr", "a"))
    from pyspark.sql import functions as F

    extra = ["n", "u", "a", "b", "v", "size", "key", "shard", "slot", "h", "id", "set", "score", "kept", "part", "bucket", "doc", "th", "c", "g", "start", "end", "e", "node", "component"]
    return df.withColumns({c: F.lit("x") for c in extra})


@pytest.fixture(scope="session")
def empty(make, spark):
    return spark.createDataFrame([], DOCS)
