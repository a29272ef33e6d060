import os
import sys

import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
SF_DIR = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} and" for i in range(30_000))


@pytest.fixture(scope="session")
def rows():
    """Whole small tables as tuples."""
    return lambda name, *columns: list(zip(*(pq.read_table(f"{SF_DIR}/{name}.parquet").column(c).to_pylist() for c in columns)))


@pytest.fixture(scope="session")
def odd_docs(rows):
    """The small documents table with null, empty, blank, very long, repeated and tied rows."""
    docs = rows("documents", "doc_id", "text")
    extra = [
        (9001, None), (9002, ""), (9003, " \t\n \r\n"), (9004, LONG), (9004, LONG), (9005, LONG + " tail"), (None, docs[0][1]), (None, None),
        (9006, docs[3][1]), (9006, docs[4][1]), (9007, "a"), (9008, "é" * 60), (9009, "x" + "é" * 60), (9010, "\x00" * 70), (9011, "\x00" * 71),
        (-5, docs[5][1]), (9012, "ab" * 100), (9013, "<|im_end|> <\\| x\ny"),
    ]
    return docs + extra


@pytest.fixture(scope="session")
def frame(spark):
    """A DataFrame of (doc_id, text) rows with columns whose names the operators use inside."""

    def make(docs, schema="doc_id long, text string"):
        df = spark.createDataFrame(docs, schema)
        for name in ("id", "hash", "fp", "chunk", "leaf", "key", "n_tokens", "_quality", "_found", "host", "m"):
            df = df.selectExpr("*", f"'clash' as {name}")
        return df

    return make
