import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with columns that clash with internal names."""
    def make(rows):
        schema = "doc_id long, text string, node string, id string, z int, token int, spans string, score string, part int"
        return spark.createDataFrame([(i, t, "x", "y", 1, 2, "s", "sc", 3) for i, t in rows], schema)
    return make


ODD_ROWS = [(1, None), (2, ""), (3, "   \n\t "), (None, "no id here at all but words"), (4, "word " * 30_000), (5, "same text twice"), (5, "same text twice"), (6, "same text twice"), (7, "é ü 你好 😀 end")]


@pytest.fixture
def odd(docs_of):
    return docs_of(ODD_ROWS)


@pytest.fixture
def empty(docs_of):
    return docs_of([])
