import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and columns whose names clash."""
    words = " ".join(f"word{k}" for k in range(60))
    rows = [
        (1, words, "en", "a"), (2, words, "en", "a"), (3, words + " more", "en", None), (4, None, None, "b"), (5, "", "de", "b"), (6, " \n\t ", "de", "b"), (6, " \n\t ", "de", "b"),
        (7, "12345 !!! ...", "en", "c"), (8, "x " * 60_000, "en", "c"), (9, "Ünï ▁ codé ½ 😀\r\n", "de", "c"), (None, "no id here at all", "en", "c"), (10, words, "en", "a"),
    ]
    more = [(*r, 1, "x", 0.5, "k") for r in rows]
    return spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long, kind string, score double, digest string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
