import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, d long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table with two extra columns whose names the operators use inside."""
    def make(texts, ids=None, sources=None):
        ids = range(len(texts)) if ids is None else ids
        sources = ["s"] * len(texts) if sources is None else sources
        rows = [(i, t, "en", s, None if t is None else len(t), "extra", 7)
                for i, t, s in zip(ids, texts, sources, strict=True)]
        return spark.createDataFrame(rows, DOCS)

    return make
