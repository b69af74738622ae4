"""Small tables with the cases that every operator must stand."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from samples import prose  # noqa: E402


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, very long, repeated and tied texts."""
    long = prose(3, 60_000)
    return [None, "", " \t\n ", "one", "é ñ 中文 😀", prose(1, 80), prose(1, 80), prose(2, 200), long, "\n".join(["same line"] * 30), "x" * 100_000, "\x00\x1f\x7f a b"]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """Those texts with a null id, repeated rows and columns whose names clash with results."""
    rows = [(i, t, ["en", None][i % 2], "s", i) for i, t in enumerate(odd_texts)]
    rows += [(7, odd_texts[7], "en", "s", 0), (None, odd_texts[5], "en", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long")


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.filter("doc_id < -5")
