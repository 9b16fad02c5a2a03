import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    def make(texts, ids=None, source="s", extra=""):
        rows = [(i if ids is None else ids[i], t, "en", source, None) + ((i,) * extra.count(" bigint")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA + extra)
    return make


@pytest.fixture(scope="session")
def sample(spark):
    """Whole texts of the smallest given table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
