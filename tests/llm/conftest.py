import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, rep int"


@pytest.fixture(scope="session")
def texts():
    """Random words with copies, near copies, repeated lines and odd cases, by id."""
    rng = random.Random(5)
    words = [a + b for a in "ba ce di fo gu ha".split() for b in "ron lit mas tek vul sor pim".split()]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = {}
    for i in range(60):
        out[i] = "\n".join(line(rng.randint(5, 25)) for _ in range(rng.randint(1, 8)))
    for i in range(60, 80):  # near copies
        w = out[i % 7].split(" ")
        w[rng.randrange(len(w))] = "changed"
        out[i] = " ".join(w)
    for i in range(80, 90):  # exact copies, and a shared passage
        out[i] = out[3] if i % 2 else line(30) + "\n" + out[5] + "\n" + line(9)
    out |= {90: None, 91: "", 92: " \n\t ", 93: "one", 94: "one two", 95: "One  TWO", 96: "é ü x " * 40, 97: "a b c d\n" * 30, 98: line(20_000), 99: "a" * 50_000}
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    langs, sources = ["en", "de", None], ["s1", "s1", "s2", None]
    return spark.createDataFrame([(i, t, langs[i % 3], sources[i % 4], len(t or ""), "x", 1, 2) for i, t in texts.items()], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
