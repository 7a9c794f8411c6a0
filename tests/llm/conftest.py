import pytest

ODD_TEXTS = [
    None, "", " ", "\n\n\t", "one", "word " * 40, "same line here\n" * 30, "x" * 50_000,
    "Über Größe ſ K   \x1c \x85 \xa0 🙂 ñandú", "a" * 2000 + "é" * 2000,
    "<|endoftext|> in <|endoftext|>text", "0" * 3000, "1.2.3.4.5.6.7.8 999.1.1.1", "\x00 nul \x00",
]


@pytest.fixture(scope="session")
def frame(spark):
    """Rows of (doc_id, text) as a table with columns whose names clash with results."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", None, 0, "x", 1, True, "q") for i, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long,"
            " spans string, n_words int, kept boolean, _text string",
        )

    return make


@pytest.fixture(scope="session")
def odd(frame):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    return frame([*rows, *rows[3:8], (5, "another text of id five"), (None, "no id"), (None, None)])
