import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, name string, scope string, kind string"
PAGES = "page_id long, url string, html string, text string, block string"

#: Nulls in every column, empty and blank texts, ties, repeated rows, clashing extra columns.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43, "x", "s", "k"),
    (2, " the quick brown fox\tjumps over the lazy dog ", "en", "a", 45, None, None, None),
    (3, None, None, None, None, None, None, None),
    (4, "", "en", "a", 0, "x", "s", "k"),
    (5, " \n\t ", "en", "a", 4, "x", "s", "k"),
    (6, "é" * 9000 + " end", "fr", "b", 9004, "x", "s", "k"),
    (7, "é" * 9000 + " end", "fr", "b", 9004, "x", "s", "k"),
    (7, "é" * 9000 + " end", "fr", "b", 9004, "x", "s", "k"),
    (None, "no id at all", "en", "a", 12, "x", "s", "k"),
    (None, "one", "en", "a", 3, "x", "s", "k"),
    (9, "one", "en", "a", 3, "x", "s", "k"),
    (10, "word " * 30000, "en", "a", 150000, "x", "s", "k"),
    (11, "\x00 odd \x0b characters \u00a0 <|endoftext|> \U0001f600", "en", "a", 30, "x", "s", "k"),
]


#: Columns with the names that operators use themselves.
CLASHING = "_uid string, __uid long, uid string, score string, class_id long, h int"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*r, "u", None, None, "s", 5, 7) for r in ODD], f"{DOCS}, {CLASHING}").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def no_pages(spark):
    return spark.createDataFrame([], PAGES)


def corpus(n: int, seed: int = 1, low: int = 5, high: int = 60) -> list[tuple[int, str]]:
    """Documents of invented words, with exact copies and copies in which some words differ."""
    import random

    rng = random.Random(seed)
    words = ["".join(rng.choice(["an", "er", "th", "on", "ble", "st", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    out: list[str] = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.15:
            out.append(rng.choice(out))
        elif out and kind < 0.4:
            copy = rng.choice(out).split()
            for _ in range(rng.randint(1, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.randint(low, high))))
    return list(enumerate(out))
