import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp string, id long, node int, `__keep` string, gone string, `a.b` int"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, long and repeated texts, repeated ids and rows, and clashing extra columns."""
    long = " ".join(f"word{i % 977} of{i % 31}" for i in range(60_000))
    texts = [
        (1, "one two three four five six seven eight nine ten eleven twelve\nsecond line of it"), (2, None), (3, ""), (4, "   \n\t "),
        (5, long), (6, long + " end"), (7, "one two three four five six seven eight nine ten eleven twelve\nsecond line of it"),
        (None, "a row without id\nsecond line of it"), (8, "x"), (8, "another text of the same id"), (9, "repeated row"), (9, "repeated row"),
        (10, "Ünïcödé 文字 と 文字 🎉 \n\n tail"), (11, "a" * 50_000),
    ]
    rows = [(i, t, None, None if n % 3 else "s", n, "x", n, None, "k", None, 1) for n, (i, t) in enumerate(texts)]
    # rows that repeat every column
    rows[11] = rows[10]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
