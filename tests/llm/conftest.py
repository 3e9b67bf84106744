import os
import random

import pytest

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _u long, node string, word string, _stats string"


def prose(seed, n=120):
    r = random.Random(seed)
    return " ".join("".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, copies, repeated rows, and columns named like internal ones."""
    base = prose(1)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    texts = {
        1: base, 2: base, 3: near, 4: None, 5: "", 6: " \t\n", 7: "one two", 8: "ONE  two", 9: prose(2, 6000), 10: prose(3),
        11: "x" * 30_000, 12: prose(4) + "\n" + base, 13: "é ü ß " * 40,
    }
    sources = [None, "b", "a", "ä", "b", "b", "b"]
    rows = [(i, t, "en", sources[i % 7], len(t or ""), i, "n", "w", "s") for i, t in texts.items()]
    rows += [rows[9], rows[9], (None, prose(5), None, "a", 1, 0, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("needs the shared tables")
    return DATA


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
