import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("block", T.StringType())])


@pytest.fixture(scope="session", autouse=True)
def one_thread():
    """Workers run side by side already."""
    import os

    os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text) as a table with further columns, one of them with a name the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "mine") for i, t in rows], DOCS)

    return make
