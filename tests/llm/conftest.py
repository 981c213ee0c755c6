from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score int, spans int, `a b` string"


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), "mine", 7, None, "x")


BASE = " ".join(f"word{i} and more{i % 7}" for i in range(40))
LONG = " ".join(f"w{i * 7919 % 1000}" for i in range(60000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names clash with results."""
    rows = [
        row(1, BASE), row(2, BASE), row(2, BASE), row(3, None), row(4, ""), row(5, "  \t\n"), row(None, "a null id with some words"),
        row(None, None, None, None), row(6, LONG), row(7, BASE + " tail"), row(8, "one"), row(9, "two words", None, None), row(10, "é ü ß 漢字 \U0001f600"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
