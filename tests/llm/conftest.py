import pytest

#: Every kind of row an operator has to stand: nulls, empty, blank, one word, repeats, odd characters.
ODD = [
    (1, "the cat sat on the mat and looked at the dog", "en", "a", 1),
    (2, "the cat sat on the mat and looked at the dog", "en", "b", 1),
    (2, "the cat sat on the mat and looked at the dog", "en", "b", 1),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \t\n", "xx-YY", "", 3),
    (6, "word", "fr", "a", 4),
    (None, "no id here, my friend", "en", None, 9),
    (7, "\U0001f600 été İstanbul K\x00\x1c end", "fr", "c", 5),
    (8, "x" * 200_000 + " " + "y z " * 50_000, "en", "a", 400_001),
    (9, "1.2.3.4 +1 (017) 555-7713 a@b.co 4111 1111 1111 1111 CC BY all rights reserved", "en", "a", 80),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with columns named like those that operators make."""
    from pyspark.sql import functions as F

    names = "key fp table part n first label row s h size bin b slot i times spans base terms of host domain suffix logs p declared component text_a"
    return odd.withColumns({c: F.lit("x") for c in names.split()})
