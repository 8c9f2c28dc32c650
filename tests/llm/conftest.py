import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """documents(doc_id, text) from pairs, with columns whose names operators use inside."""

    def make(rows):
        d = [(i, t, "en", "src0", None if t is None else len(t), "a", 7) for i, t in rows]
        return spark.createDataFrame(d, "doc_id long, text string, lang string, source string, n_chars long, row string, size int")

    return make
