"""Small tables that every operator must take: nulls, empty and long texts, ties, repeats, clashing names."""

import pytest

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards quietly mix purple juice under bright stars and count them twice before dawn".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    long = " ".join(WORDS[i % 23] + str(i * 7919 % 101) for i in range(20000))
    rows = [
        (1, "The quick brown fox. " * 30, "en", "a"),
        (2, None, None, None),
        (3, "", "en", "a"),
        (4, " \t\n ", "en", "a"),
        (5, long, "en", "a"),
        (5, long, "en", "a"),
        (6, "one", "en", None),
        (7, "É è ñ 漢字 漢字\x1c x", "fr", "b"),
        (8, "CC BY 4.0, all rights reserved. GNU General Public License", "en", "b"),
        (None, "no id here at all", "en", "b"),
        (9, "#*$%&|<> " * 20 + "\nsame line\nsame line\n\n", "en", "b"),
    ]
    return spark.createDataFrame([(*r, 0, 1.5, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, part string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
