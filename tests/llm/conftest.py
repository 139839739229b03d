import pytest

LONG = "wort " * 30_000


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, names that clash with the operators' own."""
    rows = [
        (1, "Alpha beta gamma delta.\nAlpha beta gamma delta.", "en", "a", 9),
        (1, "Alpha beta gamma delta.\nAlpha beta gamma delta.", "en", "a", 9),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (4, " \n\t ", "de", None, 4),
        (5, LONG, "de", "b", 5),
        (None, "ohne id", None, "b", 1),
        (6, "Alpha beta gamma delta.\nAlpha beta gamma delta.", None, "c", 9),
        (7, "Tab\x1fund <|endoftext|> \x85 Ende  ½ 日本語", "fr", "c", 3),
    ]
    rows = [(*r, "x", 1, 2) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, h int")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")
