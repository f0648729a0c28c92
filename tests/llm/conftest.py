import random

import pytest

#: The fixture has extra columns whose names clash with those the operators use inside.
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, size string, row string, h string, text_sha256 string"
BASE = " ".join(f"w{i}" for i in range(120))


def texts():
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "the of and to in is it on at by".split() for b in "abcdefgh"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = make(400)
    near = long.split(" ")
    near[200] = "changed"
    out = [None, "", "", "   \t\n ", "one", "One", "ONE", "two words", "É é ß İ Σ", long, long.upper(), " ".join(near), make(60)]
    out += [BASE, "start " + BASE + " end", BASE[: len(BASE) // 2] + " middle " + BASE, "a " * 200, "a " * 120, make(6000)]
    out += ["mail bob.s@mail.example.com or +1 (583) 555-8469 now 10.2.3.4 and 4111 1111 1111 1111", "call 583-555-8469 later +1 583 555 8469 583-555-8469", "<|endoftext|> it's <|startoftext|>"]
    return out + [make(rng.randrange(1, 90)) for _ in range(40)]


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and long texts, ties, and rows that repeat."""
    own = [(i, t, ("en", "de", None)[i % 3], ("src0", "src0", "b", None)[i % 4], None if t is None else len(t)) for i, t in enumerate(texts())]
    own += [own[9], own[9], (None, "one", None, "b", 3), (None, None, None, None, None), (500, own[9][1], "en", "src0", 1), (501, own[11][1], "en", "b", 1)]
    return [(*r, "x", "y", None, "z", "t") for r in own]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
