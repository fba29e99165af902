import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, tag string"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents of (doc_id, text) or (doc_id, text, lang) rows, with a column that no operator knows."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), "x") for r in rows]
        return spark.createDataFrame(full, COLUMNS)

    return make


ODD = [(1, None), (2, ""), (None, "one two three four five six"), (3, "one two three four five six"), (3, "one two three four five six"), (4, "\n \t"), (5, "é ü 漢字 \U0001f600 end"), (6, "x " * 3000), (7, "word"), (8, "0 1 2")]
