import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows with everything that the operators must bear: nulls, empty and long texts, repeats, further columns."""
    rows = [(1, "the quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "word " * 20000), (5, "the quick brown fox jumps over the lazy dog"), (5, "the quick brown fox jumps over the lazy dog"), (None, "no id here"), (6, "   \n\t "), (7, "12 34 !!")]
    return spark.createDataFrame([(i, t, "x", 1.0, i) for i, t in rows], "doc_id long, text string, score string, fp double, key long")
