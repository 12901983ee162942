import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """A frame of documents from texts, ids from 0; sources repeat a, b, null."""

    def make(texts, ids=None, sources=None):
        ids = list(range(len(texts))) if ids is None else ids
        sources = [("a", "b", None)[i % 3] for i in range(len(texts))] if sources is None else sources
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources)], SCHEMA)

    return make


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest test documents."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


#: Texts that every operator must take: null, empty, white space, one word, long, accents and astral characters, repeats.
ODD = [None, "", " \t\n", "word", "word", "é" * 30 + " 😀 x", "a b c d e f g h i j " * 400, "A b\x0bc\x0cd", None, "Ünïcode wörds\nand lines\n" * 3]
