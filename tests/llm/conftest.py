import pytest

#: Null, empty and very short texts, ties, repeated rows, a long text, passages that repeat.
PASSAGE = " ".join(f"passage{i}" for i in range(40))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (3, None),
    (4, ""),
    (5, "word"),
    (6, "  two   spaced\tand\nbroken  lines \n\n end "),
    (7, "intro " + PASSAGE + " outro"),
    (8, "Other words first, then " + PASSAGE.upper() + "; and more words after it"),
    (9, " ".join(f"w{i % 997}x{i}" for i in range(6000))),
    (10, "línea única ñandú\u00a0con blancos\u2003raros \U0001f600 e\u0301"),
    (11, "a\nb\na\nb\na\nb"),
    (11, "a\nb\na\nb\na\nb"),
    (12, PASSAGE),
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", "text") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, id string").repartition(3, "doc_id")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, id string")
