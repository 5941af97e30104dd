from __future__ import annotations

import pytest
from oracle import oracle_rows, rows_of

from basketrank.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df)
    assert got or name == "tg_none"
    if name in ORACLES:
        names, want = oracle_rows(SF, ORACLES[name])
        assert sorted(df.columns) == names
        assert got == want
