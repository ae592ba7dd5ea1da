import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None):
        rows = [(i if ids is None else ids[i], t, None, None, None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def real_docs(spark):
    """The documents of the smallest test tables, whole."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
