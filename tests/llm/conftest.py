import pytest

LONG = "word " * 60_000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of every awkward kind, with further columns whose names operators use themselves."""
    rows = [
        (1, "One line of text that repeats\nand one that does not repeat, ever", 5), (2, "One line of text that repeats\nsomething else entirely in here", 5),
        (2, "One line of text that repeats\nsomething else entirely in here", 5), (3, None, None), (4, "", 0), (None, "One line of text that repeats", 1),
        (None, None, None), (5, LONG, 9), (6, " \t\n\n ", 4), (7, "ünï 日本語 😀 <|endoftext|> 'll ", 3), (8, "short", 5), (2, "another text of the same id", 5),
    ]
    rows = [(i, t, "en", None, n, 1.5, "x", [1], 7) for i, t, n in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, hash string, items array<int>, shard int").cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
