import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, node bigint, score double, row string, cells string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents with columns whose names the operators use inside."""

    def call(rows, schema=COLUMNS):
        return spark.createDataFrame([(i, t, "en", "s", None, 7, 7, 7.0, "r", None) for i, t in rows], schema)

    return call


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empties, white space, ties, repeats, a very long text and odd characters."""
    long = " ".join(f"w{k % 9000}" for k in range(60_000))
    return [(1, None), (2, ""), (3, " \n\t"), (None, "a null id has words too here"), (5, "Ab c  d\x0be f"), (6, "ab C d e F"), (6, "ab C d e F"), (7, long), (8, long + " tail"), (9, "x" * 5000), (10, "é漢字 😀 ok no <|endoftext|>")]
