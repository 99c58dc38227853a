import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names
    the operators use themselves."""
    long_text = " ".join(f"word{k % 997} the of und" for k in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a"),
        (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a"),
        (2, "the QUICK brown fox  jumps over the lazy dog and runs away", "en", "b"),
        (3, None, "en", "a"), (4, "", None, "a"), (5, " \t\n ", "de", None), (None, "no id here, but five words", "en", "b"),
        (6, long_text, "en", "c"), (7, long_text + " end", "en", None), (8, "x" * 30_000, None, "c"),
        (9, "1234 5678 !!", "en", "b"), (10, "Der schnelle Fuchs und das Haus", "de", "b"), (11, "one two", None, "b"), (12, "One TWO", None, None),
    ]
    extra = [(*r, len(r[1] or ""), k, "n", 1.5) for k, r in enumerate(rows)]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, size long, node string, score double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
