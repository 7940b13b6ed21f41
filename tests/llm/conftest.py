import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def texts(spark):
    """Make a documents frame of ``(doc_id, text)`` with columns whose names clash with results."""

    def make(rows):
        extra = ", score double, label string, spans string, `key` long, source string, lang string"
        filled = [(i, t, 0.5, "x", "y", 1, None if n % 5 == 4 else f"s{n % 3}", "en" if n % 2 else "de") for n, (i, t) in enumerate(rows)]
        return spark.createDataFrame(filled, "doc_id long, text string" + extra)

    return make


#: null, empty, blank, and very long texts, repeated rows, a null id
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "word " * 30_000), (5, "same text here"), (5, "same text here"), (None, "no id at all"), (7, "é" * 5000)]


@pytest.fixture(scope="session")
def odd(texts):
    return texts(ODD)
