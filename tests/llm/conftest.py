from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, `a.b` int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with two extra columns, from (doc_id, text) or (doc_id, text, source)."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", 1) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make
