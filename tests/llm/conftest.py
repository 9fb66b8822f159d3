import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, mark string, part int, Slot string, pieces string"


def table(spark, rows):
    """Documents with extra columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), -1, "x", "y", 7, "z", "p") for i, t, lang, source in rows], SCHEMA)


ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, "the and of this with", "en", "a"),
    (3, "the and of this with", "en", "a"),
    (4, "the and of this with", "en", "a"),
    (5, " \t\n ", None, "b"),
    (6, "123 456 !!! \U0001f600", "en", None),
    (7, "de la les des une pour dans " * 3000, "fr", "b"),
    (None, "the and of this with", "en", "a"),
    (9, "é", "fr", "b"),
    (2, "another text of the same id", "en", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return table(spark, ODD).cache()


@pytest.fixture(scope="session")
def none(spark):
    return table(spark, [])
