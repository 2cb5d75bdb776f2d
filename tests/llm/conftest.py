import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, t string, id string, node long, key string, h1 long"


def make(spark, rows):
    """Documents with columns whose names the operators use inside."""
    full = [(i, t, lang, src, len(t) if t else 0, "r", "t", "i", 1, "k", 2) for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA)


WORDS = [f"w{i}x" for i in range(400)]


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    long = prose(1, 30_000)
    base = prose(2, 120)
    rows = [
        (1, None, "en", "a"), (2, "", None, "a"), (3, long, "en", None), (4, base, "en", "b"), (4, base, "en", "b"), (5, base, None, "b"),
        (None, base, "en", "a"), (6, "  \n\t ", "en", "a"), (7, "One.", "en", "a"), (8, base + " tail", "en", None), (9, "\n".join(["same line here"] * 30), "en", "c"), (None, None, None, None),
    ]
    return make(spark, rows)


@pytest.fixture(scope="session")
def none(spark):
    return make(spark, [])
