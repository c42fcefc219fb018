import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing column names."""
    rows = [
        (1, "a b c d e f g h i j k l", "en", "s"), (1, "a b c d e f g h i j k l", "en", "s"), (2, "A b c d e f g h i j k l", None, None), (3, None, "en", "s"), (4, "", "en", "s"), (5, " \n\t ", "en", "s"),
        (None, "a b c d e f g h i j k l", "en", "s"), (6, "x", "de", "s"), (7, "wort " * 30000, "de", "s"), (8, "one\none\none\ntwo", "en", "s"), (9, "Ñandú €uro 日本 " * 20, "es", "s"),
    ]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCUMENTS)
    for name in ("label", "node", "key", "group", "part", "n", "__pii_text", "__PII", "__pii_key", "__keep_id", "found", "first"):
        df = df.selectExpr("*", f"'clash' AS `{name}`")
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def some_labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
