import pytest

#: Columns that clash with names used inside the operators.
CLASH = "key long, n long, token string, a long, b long, comp long, y int, draw long, part int, score double"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) pairs with clashing columns beside."""

    def make(pairs):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, 2, "t", 3, 4, 5, 1, 6, 0, 0.5) for i, t in pairs], "doc_id long, text string, lang string, source string, n_chars long, " + CLASH)

    return make


LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd_pairs():
    """Nulls, empty and very long texts, repeated rows, ties."""
    return [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, LONG), (7, "a b c d e f"), (8, "É è x <|endoftext|> ok"), (None, "no id here"), (9, "a b c d e f")]
