import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, taken string, component_id long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents with columns that clash with names the operators use."""

    def make(rows):
        full = [(i, t, "en", s, len(t or ""), "extra", 7) for i, t, s in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empties, a very long text, ties, repeated rows."""
    words = " ".join(f"w{i % 97}x{i % 89}" for i in range(30_000))
    return make_docs([
        (1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (4, words, "b"), (5, "one two three four five six seven", None),
        (6, "One two THREE four five six seven", "b"), (None, "one two three four five six seven", "a"), (7, "same row here it is again", "c"),
        (7, "same row here it is again", "c"), (8, "x", "a"),
    ])


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
