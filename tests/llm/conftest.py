import pytest

#: Extra columns whose names operators might use for themselves.
CLASH = "k1 string, n string, key string, row string, word string, t string, a string, text_ string, keys string, component string"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table, with columns that clash with what operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t), *["x"] * 10) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")

    return make


@pytest.fixture(scope="session")
def corpus(spark):
    """Part of the smallest corpus, for the brute-force versions."""
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]


EDGES = [(900_001, None), (900_002, ""), (900_003, " \n\t"), (900_004, "word"), (900_004, "word"), (None, "no id here at all"), (900_005, "é ß 漢字 😀\nx\n\n"), (900_006, "long " * 40_000)]


@pytest.fixture(scope="session")
def edges():
    return EDGES
