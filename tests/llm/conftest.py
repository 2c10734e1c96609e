import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with languages and sources that may be null."""

    def build(rows, extra=""):
        full = [(i, t, None if i is not None and i % 7 == 3 else "en", None if i is not None and i % 5 == 4 else "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, COLUMNS)

    return build


@pytest.fixture(scope="session")
def prose():
    """Distinct word sequences, the same in every run."""
    import random

    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzäé"
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(4000)]

    def text(seed, n):
        r = random.Random(seed)
        return " ".join(r.choice(vocabulary) for _ in range(n))

    return text


@pytest.fixture(scope="session")
def odd(prose):
    """Rows that every operator has to bear: nulls, blanks, very long texts, repeated rows."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, prose(1, 6000)), (5, prose(2, 120)), (5, prose(2, 120)), (6, prose(2, 120)), (7, "one"), (None, prose(3, 60)), (8, "\n\n".join([prose(4, 30)] * 3))]
