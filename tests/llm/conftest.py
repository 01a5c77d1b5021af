import random

import pytest

LONG = "x" * 300


@pytest.fixture(scope="session")
def texts():
    """Invented documents with copies, near copies, shared passages and odd cases."""
    rnd = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "rt", "lo", "mi")]
    make = lambda n: [rnd.choice(words) for _ in range(n)]
    out = [" ".join(make(rnd.randint(30, 120))) for _ in range(40)]
    base = make(90)
    for _ in range(12):  # near copies
        copy = list(base)
        for _ in range(rnd.randint(0, 5)):
            copy[rnd.randrange(90)] = rnd.choice(words)
        out.append(" ".join(copy))
    out += [out[0], out[0], out[3] + " " + out[4], "tail " + out[5][20:], (" ".join(base[:3]) + " ") * 60]
    out += [None, "", "   ", "one", "two words", "123 ,.!", "Ünïcödé " * 30, "a\x00b\x1cc\x85d \U0001f600", "y" * 5000, LONG, LONG]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Ids, repeated rows, a null id and columns whose names clash with results."""
    rows = [(i, t, None if i % 7 == 0 else ("aa", "bb")[i % 2], "s", len(t or ""), 1.0, "old", [1]) for i, t in enumerate(texts)]
    rows += [rows[1], (None, texts[2], "aa", None, 0, 1.0, "old", [1])]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, spans string, keys array<int>"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)
