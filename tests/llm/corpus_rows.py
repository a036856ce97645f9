"""Documents and fixtures for the tests of this folder."""

import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "key string, spans string, text_id string, rep string, size string, n string, a string, b string, "
          "component string, label string, held_out string, kept string, m string, items string")


def row(doc_id, text, lang="en", source="s"):
    """A document; the extra columns have names that operators use inside."""
    return (doc_id, text, lang, source, None if text is None else len(text), *["x"] * 14)


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows):
        return spark.createDataFrame(rows, SCHEMA)
    return make


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(rng.choice(["", "th", "er", "on", "é", "ß"]) + f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edge_rows():
    """NULLs, empty and blank texts, a very long one, repeated rows, near and
    exact copies, shared passages, periodic text and ties."""
    passage, base = prose(1, 90), prose(2, 300)
    words = base.split()
    near = " ".join(w if i % 60 else "changed" for i, w in enumerate(words))
    return [
        row(None, base), row(None, None), row(1, None, None, None), row(2, ""), row(3, " \t\n "),
        row(4, base), row(4, base), row(5, base), row(6, near), row(7, prose(3, 50) + " " + passage),
        row(8, passage + "\n" + prose(4, 60)), row(9, "one"), row(10, "one"), row(11, "one two"),
        row(12, "le " * 900), row(13, "abc " * 700 + "le " * 400), row(14, "x" * 1200), row(15, "x" * 1200 + "y"),
        row(16, prose(5, 20000, 5000) + " " + passage), row(17, "Été " * 3 + passage.upper()), row(-3, "éé"),
        row(18, near.replace("changed", "other")), row(19, "# $ % !!! ..."), row(20, passage),
    ]


@pytest.fixture(scope="session")
def edge(frame):
    rows = edge_rows()
    return frame(rows), rows
