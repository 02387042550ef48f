import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, piece int, start long, score double, `_row` string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts (ids from 0, or given as pairs), with columns named like those the operators make."""

    def documents(texts):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, None, None, None, 7, 7, 7.0, "x") for i, t in pairs], DOCS)

    return documents


ODD = [None, "", "a", "a", (None, "no id"), (None, None), (3, "a"), (3, "b"), "é" * 9_000 + " x" * 9_000]
