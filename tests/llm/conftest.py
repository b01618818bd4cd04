import pytest

TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (3, "", "en", None),
    (4, None, None, "b"),
    (5, " \t\n\x0b ", "fr", "b"),
    (6, "one two three", "en", "a"),
    (6, "one two three", "en", "a"),
    (None, "a text without an id, mail me at x.y@example.com or +1 (555) 010-9999", "en", "c"),
    (8, "word " * 30000, "en", "a"),
    (9, "été  naïve\r\nSame line\nSame line\n" * 3 + "4111 1111 1111 1111; 10.0.0.256 10.0.0.1", "fr", "c"),
    (10, "Licensed under the MIT license.\nBody", "en", "c"),
]
#: extra columns whose names clash with those that operators add
CLASH = ("n", "size", "score", "taken", "node", "kept", "spans", "n_tokens", "comp", "edits")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, a long text, repeated rows and clashing extra columns."""
    rows = [(*r[:2], *r[2:], len(r[1] or ""), *["x"] * len(CLASH)) for r in TEXTS]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame(rows, kinds)


@pytest.fixture(scope="session")
def none(odd):
    """The same table without rows."""
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 0, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame(
        [(1, "quick brown fox jumps over the lazy dog near the river bank"), (2, "three"), (3, None), (4, " "),
         (4, "quick brown fox jumps over the lazy dog near the river bank")], "item_id long, text string")
