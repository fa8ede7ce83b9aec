from __future__ import annotations

import pytest
from pyspark.sql import types as T

KINDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents from texts or (doc_id, text) or (doc_id, text, source)."""

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            full.append((r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")))
        return spark.createDataFrame(full, KINDS)

    return make
