import pytest


@pytest.fixture(scope="session")
def tables(spark):
    """The smallest driver tables."""
    return "/root/testdata/sf0.001"


#: Texts that every text operator has to bear.
ODD_TEXTS = [None, "", " \t\n ", "x", "!!!", "a\x00b", "ÉÉ ß İ 中文 ▁ \U0001f600", "word " * 3, "the same text twice over", "the same text twice over"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, a null id, extra columns with names the operators use."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, None) for i, t in enumerate(ODD_TEXTS)]
    rows += [(3, "x", "en", "s0", 1), (3, "x", "en", "s0", 1), (None, "no id", "de", None, 7), (None, None, None, None, None), (90, "long " * 30_000, "en", "s1", 5), (91, "unbroken" * 20_000, "en", "s1", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    from pyspark.sql import functions as F

    extra = ("size", "key", "doc", "tag", "words", "x", "held_out", "position", "copy", "kept", "tokens", "fp", "v", "id", "removed", "count", "score", "ids")
    return df.withColumns({c: F.lit(c) for c in extra})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
