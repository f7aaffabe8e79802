import pyarrow.parquet as pq
import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def texts():
    """The smallest documents by id."""
    table = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))


@pytest.fixture(scope="session")
def as_documents(spark):
    """Documents from (id, text) pairs, with columns whose names clash with the operators' own."""

    def make(rows):
        rows = [(i, t, "x", i, i) for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, version string, bits long, start long")

    return make
