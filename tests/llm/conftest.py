from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, source)."""

    def build(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)

    return build


#: Rows that every operator must take: null and empty texts, equal rows, one id twice, a null id, a very long text, odd characters.
ODD = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (3, "other words here"), (None, "no id at all"), (5, "x" * 70_000), (6, "wörd " * 9_000), (7, " \n\t "), (8, "emoji 😀 and \u0000 nul and 'quotes'"), (9, "one")]


@pytest.fixture
def odd(make):
    """ODD with columns that clash with the operators' own names."""
    df = make(ODD)
    for name in ("id", "digest", "row", "hash", "size", "taken", "score", "spans", "class_id", "n_links", "kept", "bucket", "part"):
        df = df.withColumn(name, df.lang)
    return df
