import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns whose names operators
    use inside."""
    long = " ".join(f"word{i % 997} and{i % 13}" for i in range(20_000))
    same = "the quick brown fox jumps over the lazy dog " * 4
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n\x0b ", "en", None, 1), (4, long, "en", "b", None), (5, same, None, "b", 5), (5, same, None, "b", 5), (6, same + "End", "de", "b", 7),
        (None, "no id here but some words to count", "en", "c", 3), (7, "Ünïcode ÉÀ\nline\nline\n line", "fr", "c", 3), (8, "one", "en", "", 1), (9, "#*$ %&| <|endoftext|> <|im_end|>", "en", "c", 2), (10, same, "en", "a", 2), (11, "x  y\t\tz  ", "en", "a", 2), (12, "𝔘𝔫𝔦 日本語 text", "ja", "z", 1),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    df = spark.createDataFrame(rows, schema)
    for c in ("size", "row", "score", "n_words", "target", "slot", "component", "token", "key", "y"):
        df = df.selectExpr("*", f"'x' AS {c}")
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
