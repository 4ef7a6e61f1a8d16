import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use themselves
    T.StructField("size", T.StringType()), T.StructField("key", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("toxicity", T.StringType()), T.StructField("row_key", T.StringType()),
])


def words(start, n):
    """n words that no other start repeats."""
    return " ".join(f"w{start}x{i}" for i in range(n))


def rows_of(texts, first=0):
    return [(first + i, t, "en", f"s{i % 3}", None if t is None else len(t), "x", "k", "l", "t", "r") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        return spark.createDataFrame([r if len(r) == len(DOCUMENTS) else (*r, *["x"] * (len(DOCUMENTS) - len(r))) for r in rows], DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    passage = words("p", 60)
    rows = rows_of(["", None, " ", "one", "one two three", "A b. C d!", passage, words("a", 30) + " " + passage, words("b", 40), words("c", 5000), "x" * 30_000, "naïve Été 漢字 🙂\n\n\ttail "])
    rows += [rows[8], rows[8], (None, None, None, None, None, *["x"] * 5), (None, words("b", 40), None, None, 3, *["x"] * 5), (8, "other text", "en", "s0", 10, *["x"] * 5)]
    return rows
