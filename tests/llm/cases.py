"""Rows that every operator over documents must cope with."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, half int, k long, node string"
LONG = "the stone that lies over the well is heavy and " * 20_000


def rows(texts):
    """Documents with further columns of clashing names."""
    return [(i, t, "en", f"src{i % 3}", len(t or ""), "x", 1, 7, "y") for i, t in enumerate(texts)]


EDGES = [
    (None, "no id at all, but some words to read", "en", "a", 1, None, None, None, None),
    (1, None, None, None, None, None, None, None, None),
    (2, "", "en", "a", 0, "x", 1, 1, "n"),
    (3, "   \n\t ", "en", "a", 5, "x", 1, 1, "n"),
    (4, "!!! ??? ...", "de", None, 9, "x", 1, 1, "n"),
    (5, "one", "en", "b", 3, "x", 1, 1, "n"),
    (6, "one two", "en", "b", 7, "x", 1, 1, "n"),
    (7, "ein Wort für dich 中文 🙂", "de", "b", 20, "x", 1, 1, "n"),
    (8, LONG, "en", "c", len(LONG), "x", 1, 1, "n"),
    (9, "tie tie tie tie", "en", "c", 15, "x", 1, 1, "n"),
    (10, "tie tie tie tie", "en", "c", 15, "x", 1, 1, "n"),
    (11, "the same row twice over in this table", "fr", "d", 3, "x", 1, 1, "n"),
    (11, "the same row twice over in this table", "fr", "d", 3, "x", 1, 1, "n"),
    (None, None, None, None, None, None, None, None, None),
]


def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
