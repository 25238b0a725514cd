"""Every query that has SQL against DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from voxelspring.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "embeddings", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a, b = (t[columns].sort_values(columns).reset_index(drop=True) for t in (ours, theirs))
    assert len(a) == len(b)
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c
