import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, fp long, crc long, row string, hash long, copies int, score double"


def frame(spark, rows):
    """documents rows of (doc_id, text, source) with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), -7, "k", 3, 4, "r", 5, 6, 0.5) for d, t, s in rows], COLUMNS)


LONG = " ".join(f"word{k % 977}x{k}" for k in range(30_000))
ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n\x0b ", None), (4, "one", "b"), (5, "one two", "b"), (6, "A b\nA b\n\nc d", "b"), (7, "same text here with five words", "c"), (7, "same text here with five words", "c"),
    (8, "same text here with five words", None), (None, "a row without an id", "c"), (None, "a row without an id", "c"), (9, LONG, "d"), (10, LONG + " end", "d"), (11, "é ñ ü 中文 😀 naïve", "d"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD).cache()


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, []).cache()
