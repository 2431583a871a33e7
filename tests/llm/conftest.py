import random

import pytest

WORDS = "the of and red blue tree house river stone light over under again never always storm winter glass bird song".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ly", "s"]) for _ in range(n))


def tricky_rows():
    base = prose(1, 120)
    near = base.replace(base.split()[60], "altered", 1)
    long = prose(2, 6000)
    rows = [(1, base), (2, None), (3, ""), (4, "  \n\t "), (5, base), (6, near), (7, long), (7, long), (None, prose(3, 30)),
            (8, "one two"), (9, "One TWO"), (10, "é ü 中文 ñ 😀"), (11, "x" * 5000), (12, "12 34 5.6.7.8"), (13, prose(4, 60))]
    rows += [(20 + i, f"Shared line number {i} with the very same words here\n" + prose(50 + i, 25)) for i in range(6)]
    return rows


@pytest.fixture(scope="session")
def tricky(spark):
    """Missing, empty, very long, equal and similar texts, a repeated row, a row without id, and columns that clash."""
    rows = [(i, t, "en" if i is None or i % 3 else "fr", "n", 1, True, "other") for i, t in tricky_rows()]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, cell string, n int, held_out boolean, `TEXT` string")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="session")
def texts():
    return tricky_rows()
