"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import os
import sys

import pytest
from paths import ROOT, SMALL

sys.path.insert(0, os.path.join(ROOT, "tools"))

from check_oracles import connect, rows  # noqa: E402

from quirework.plans import registry  # noqa: E402

ORACLES = registry.oracle_sql()

NAMES = list(registry.queries())


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SMALL)
    got = rows(df.columns, df.collect())
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, cursor.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
