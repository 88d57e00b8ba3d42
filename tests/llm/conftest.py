import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, fp double, words string, base int, `spans` int"
LONG = ("Quiet harbours keep their lamps burning through the night, and nobody asks why. " * 400).strip()
PASSAGE = "The seventh lighthouse keeper catalogued forty amber lanterns before dawn. His ledger names every ship that passed the strait between harvest and snow. Nobody since has matched those careful columns of salt stained numbers."


def table(spark, texts, lang="en"):
    """Documents 0, 1, ... with the given texts, and extra columns whose names the operators use inside."""
    rows = [(i, t, lang, "s", len(t or ""), "k", 1, 0.5, "w", 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def hard(spark):
    """Null and empty texts, a null id and language, repeated rows, ties, a very long text, odd characters."""
    texts = ["", None, "one", "a b", LONG, LONG, "x" * 30000, "éé \U0001f600   mail a@b.cd now", " \t\n\x0b\f\r ", "Same. Same. Same.\nSame. Same. Same.\n"]
    rows = [(i, t, "en" if i % 2 else None, None, None, None, None, None, None, None, None) for i, t in enumerate(texts)]
    rows += [(4, LONG, "en", "s", 1, "k", 1, 0.5, "w", 1, 1), (None, "no id here", "zz", "s", 1, "k", 1, 0.5, "w", 1, 1), (None, None, None, None, None, None, None, None, None, None, None), (4, LONG, "en", "s", 1, "k", 1, 0.5, "w", 1, 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
