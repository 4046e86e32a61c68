from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs(spark):
    """Documents from texts, or from rows (doc_id, text, lang, source)."""

    def make(rows):
        rows = [(i, t, "en", "s") if not isinstance(t, tuple) else t for i, t in enumerate(rows)]
        return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows], DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def sf():
    import os

    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no tables here")
    return path
