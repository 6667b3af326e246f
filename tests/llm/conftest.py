import pytest

CLASHING = ["row", "dropped", "n_words", "sig", "path", "doc", "kept", "spans", "ids", "block", "host"]


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names an operator could use itself."""
    def make(rows):
        schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)
        return spark.createDataFrame([(d, t, *[f"x{d}"] * len(CLASHING)) for d, t in rows], schema).repartition(3)
    return make


@pytest.fixture(scope="session")
def odd_texts():
    """NULLs, blanks, repeated rows, ties, a very long word, a very long line, many lines."""
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "one"), (None, "one"), (None, None), (6, "a" * 300_000),
            (7, "word " * 60_000), (8, "\n" * 5000), (9, "\n".join(f"line {k % 7} of text" for k in range(3000))), (10, "é日\U0001F600 \x00 x")]
