import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the cat sat on a mat. " * 9_000 + "x" * 30_000


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: spark.createDataFrame([(r + (None,) * 5)[:5] for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns whose names clash with those inside."""
    rows = [
        (1, "Ein Text, der Hallo sagt.", "de", "a", 25),
        (2, None, "de", "a", None),
        (3, "", None, "b", 0),
        (4, " \t\n ", "en", None, 4),
        (None, "no id at all, but words", "en", "b", 23),
        (None, None, None, None, None),
        (5, LONG, "en", "a", len(LONG)),
        (6, "the same row", "en", "a", 12),
        (6, "the same row", "en", "a", 12),
        (7, "the same row", "fr", "c", 12),
        (8, "mail me at a.b@c.de or +1 (555) 010-9999 \U0001f642 \x00 end", "en", "b", 50),
        (9, "丝绸之路 ﷽ é", "zh", "b", 9),
    ]
    clash = "key size cum copies fp component_id x f row k ids score scale grp distance kept n_words words texts block weight budget level target taken copy held_out positive v root".split()
    return make(rows).withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
