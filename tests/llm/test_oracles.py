"""The operators' queries that SQL can express, against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from quarrylight.llm import registry
from tests.test_oracles import rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, name):
    duck = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = rows(r.asDict() for r in registry.QUERIES[name](spark, SF).collect())
    rel = duck.sql(registry.ORACLES[name])
    assert got == rows(dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall())


def test_all_are_registered():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()
