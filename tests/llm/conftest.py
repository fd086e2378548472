import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with names that operators use inside."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(6000))
    rows = [
        (1, "the same text of some words here", "en", "s1"), (2, "the same text of some words here", "en", "s1"), (2, "the same text of some words here", "en", "s1"), (3, None, None, None), (4, "", "en", "s2"),
        (5, " \t\n ", "en", None), (6, long, "en", "s2"), (7, long + " tail", None, "s1"), (8, "a\x00b ▁ ﬁ 𝔘 <|endoftext|> x", "fr", "é"), (9, "one two three", "en", "s1"), (None, "no id at all", "en", "s1"),
    ]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return base.selectExpr("*", "1 as key", "2 as block", "'t' as t", "3 as size", "4 as bucket", "5 as score", "6 as rep", "7 as kept", "'x' as target", "8 as n_grams", "9 as rid", "10 as head", "11 as term", "12 as label", "13 as y").cache()
