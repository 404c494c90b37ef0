import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                          T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                          T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Builds a documents table from (doc_id, text[, lang, source]) rows, with a column that clashes with inner names."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s",
                 None if r[1] is None else len(r[1])) for r in rows]
        docs = spark.createDataFrame(full, DOCUMENTS)
        from pyspark.sql import functions as F
        return docs.withColumns({c: F.lit("x") for c in ("id", "key", "blob", "spans", "range", "node", "component")})
    return make


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) of the small documents table."""
    import pyarrow.parquet as pq
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))

#: Nulls, empty and tiny texts, ties, repeated rows and one long text.
EDGES = [(1, None), (2, ""), (3, "   "), (4, "one"), (5, "one two three four"), (6, "one two three four five six"),
         (6, "one two three four five six"), (7, "one two three four five six"), (None, "a null id"), (None, None),
         (8, LONG), (9, LONG + " end"), (10, "ÀÉ ñandú 漢字 <|endoftext|> x"), (11, "\t\n \r"), (12, "12345 !!")]
