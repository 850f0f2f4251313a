import pytest

#: Texts that every operator has to take.
ODD = [None, "", " \n\t ", "one", "one two", "a\n\nb", "x" * 50_000, "word " * 20_000, "é 漢字 😀   z"]


@pytest.fixture()
def odd_docs(spark):
    """Odd texts, a repeated row, a null id, and columns whose names the operators use inside."""
    rows = [(i, t, "s" if i % 2 else None, float(i), "x") for i, t in enumerate(ODD)]
    rows += [rows[3], (None, "no id", None, 0.0, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double, key string")


@pytest.fixture()
def no_docs(odd_docs):
    return odd_docs.where("false")
