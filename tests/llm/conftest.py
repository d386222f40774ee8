import pytest

ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (6, "A b C d e F g h"),
    (7, " ".join(f"w{i}" for i in range(60))), (8, "x " + " ".join(f"w{i}" for i in range(60)) + " y"), (9, "tie " * 200), (10, "é" * 3000), (11, "z" + " q1" * 30_000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in each column, empty and long texts, repeated rows and ids, columns with clashing names."""
    rows = [(i, t, None, "s", 1, 2, 3) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, block string, score int, class int, n int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
