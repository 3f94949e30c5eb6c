import pytest
from llm_cases import ROWS


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with every odd case, and columns whose names could clash."""
    schema = "doc_id long, text string, source string, lang string, n_chars long, key long, h string, fp double, entries array<int>, family string, n_words string, kept int, removed string, d string, t string, n string, rank int, part string"
    rows = [(i, x, s, "en", len(x or ""), 1, "h", 1.0, [1], "f", "n", 0, "r", "d", "t", "n", 1, "p") for i, x, s in ROWS]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none(edge):
    return edge.where("false")
