from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, n_tokens int, t string, node string"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns whose names operators use inside."""
    long = "lorem ipsum dolor sit amet " * 8_000
    rows = [(1, None), (2, ""), (3, " "), (4, "One two three four five six seven eight nine ten."), (5, "One two three four five six seven eight nine ten."), (5, "One two three four five six seven eight nine ten."), (6, long), (None, "no id here at all"), (8, "x" * 30_000), (9, "mail a.b@example.com or +1 (743) 555-3824, MIT License")]
    return spark.createDataFrame([(*r, 0, "clash", "clash") for r in rows], DOCS)
