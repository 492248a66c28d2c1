import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a table of documents from texts, or from rows of (doc_id, text)."""

    def make(rows, extra=False):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        if extra:  # columns whose names could clash with an operator's own
            return spark.createDataFrame([(i, t, "k", 1, "c") for i, t in rows], "doc_id long, text string, fp string, n_lines int, lang string")
        return spark.createDataFrame(rows, "doc_id long, text string")

    return make
