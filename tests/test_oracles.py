"""Every base query against its DuckDB twin on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quarrylight.plans import more_queries  # noqa: F401
from quarrylight.plans import queries as base

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(pairs):
    def plain(v):
        return None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v

    return sorted(str(sorted((k, plain(v)) for k, v in r.items())) for r in pairs)


@pytest.mark.parametrize("name", sorted(base.QUERIES))
def test_same_rows(spark, duck, name):
    got = rows(r.asDict() for r in base.QUERIES[name](spark, SF).collect())
    rel = duck.sql(base.ORACLES[name])
    assert got == rows(dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall())
