import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, kept boolean, key string, a long, b long, start int"


def _row(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), 7, 0.5, True, "k", 1, 2, 3)


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, short, very long, repeated and nearly equal texts; null and repeated ids, langs and sources."""
    base = words(1, 120)
    near = base.split()
    near[60] = "changed"
    long = words(2, 20_000)
    return [
        _row(1, None, None, None), _row(2, ""), _row(3, " \t\n "), _row(4, "one"), _row(5, "one two three"), _row(6, base), _row(7, base), _row(8, " ".join(near)),
        _row(9, long), _row(10, long + " end"), _row(11, words(3, 80), "de", None), _row(12, words(3, 80), None, "t"), _row(13, "Ünï¢ödé 😀   x y ÀÉ"), _row(14, "x" * 50_000),
        _row(14, "x" * 50_000), _row(None, "no id at all", "fr", ""), _row(15, base.upper()), _row(16, words(4, 30) + " " + base + " " + words(5, 30), "es", "u"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
