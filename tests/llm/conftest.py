import pytest


@pytest.fixture(scope="session")
def rows(spark):
    """Small documents with NULLs, ties, repeated rows, blank, empty and long texts, and clashing column names."""
    long = " ".join(f"w{i * i % 977}" for i in range(30_000))
    near = " ".join(f"n{i}" for i in range(200))
    made = [
        (1, near, "a"), (2, near + " tail", "a"), (3, near.upper(), "b"), (3, near.upper(), "b"), (None, near, None),
        (5, None, "a"), (6, "", "a"), (7, " \n\t ", None), (8, "one two", "b"), (9, "ONE  two", "b"), (10, long, "c"),
        (11, long + " end", "c"), (12, "header\nalpha beta\nheader\n\nheader", "d"), (13, "x", None), (None, None, None),
    ]
    schema = "doc_id bigint, text string, source string, ledger int, ids string, token string, n int, fp int, hit int, `odd name` int"
    return spark.createDataFrame([(*r, 1, "i", "t", 2, 3, 4, 5) for r in made], schema)


@pytest.fixture(scope="session")
def empty(rows):
    return rows.filter("false")
