import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, score string, spans string"


@pytest.fixture
def docs(spark):
    """docs([(id, text), (id, text, lang, source)...]): rows with extra columns named like results."""

    def make(rows):
        full = [(*r, *([None] * (4 - len(r))), None, "k", "r", "s", "x") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make
