from __future__ import annotations

import pytest
from cases import HARD
from pyspark.sql import types as T

#: Names that operators use inside; a table may have columns called the same.
CLASH = ("id", "fp", "token", "_d", "_m", "shard", "rid", "spans", "n_words", "kept", "node")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, lang, source); with columns whose names clash, if wanted."""
    def make(rows, extra=False):
        schema = T.StructType([
            T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
            T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
            T.StructField("n_chars", T.LongType())])
        data = [(*r, *(None,) * (4 - len(r)), None if r[1] is None else len(r[1])) for r in rows]
        if extra:
            for c in CLASH:
                schema.add(c, T.StringType())
            data = [(*d, *("x",) * len(CLASH)) for d in data]
        return spark.createDataFrame(data, schema)

    return make


@pytest.fixture(scope="session")
def hard(make_docs):
    return make_docs(HARD, extra=True)


@pytest.fixture(scope="session")
def empty(make_docs):
    return make_docs([], extra=True)
