import pytest

#: The texts of edge cases: null, empty, white space, ties, repeats, very long.
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "Abc def ghi"), (5, "abc DEF ghi"), (6, "É"), (7, "é"), (8, "word " * 300_000), (9, "one"), (9, "one"), (None, "a b c d"), (10, "x  y \n z's 'quoted' 12,5"), (11, "\x00 nul \x1f")]


@pytest.fixture(scope="session")
def edge(spark):
    """The edge cases with extra columns whose names operators use inside."""
    rows = [(d, t, "en", "s", "k", 1, 2, 3.0) for d, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, path string, fp int, rep int, score double")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
