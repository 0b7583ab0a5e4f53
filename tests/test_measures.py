"""Sketches, exact percentiles, bucketed snapshots and laid-out tables."""

import math
import random
import uuid
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrylight.operators import measures, sync
from quarrylight.plans import more_queries as more
from quarrylight.plans import queries as base
from quarrylight.sources import tables

SF = "/root/testdata/sf0.001"


def plain(values, q):
    values = sorted(v for v in values if v is not None and math.isfinite(v))
    return values[max(1, math.ceil(q * len(values) - 1e-9)) - 1]


@pytest.mark.parametrize("bins", [40, 1024])
def test_percentiles(spark, bins, monkeypatch):
    monkeypatch.setattr(measures, "BINS", bins)
    r = random.Random(4)
    groups = {
        "even": [float(i) for i in range(500)],
        "skew": [10 ** r.uniform(-300, 300) * r.choice([1, -1]) for _ in range(300)],
        "equal": [2.5] * 40,
        "two": [1.0, math.nextafter(1.0, 2)] * 7,
        "ends": [-1.7e308, 1.7e308, 0.0, -0.0, 5e-324],
        "one": [7.0],
        None: [3.0, 1.0, 2.0],
        "holes": [None, math.nan, math.inf, 4.0],
        "none": [None],
    }
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, value double")
    fractions = [0.0, 0.01, 0.5, 0.9, 1.0]
    got = {(x.g, x.fraction): x.value for x in measures.exact_percentiles(rows, ["g"], "value", fractions).collect()}
    assert got == {(g, q): plain(vs, q) for g, vs in groups.items() if g != "none" for q in fractions}


def test_percentiles_of_nothing_and_of_all(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(11)], "value double")
    assert [x.value for x in measures.exact_percentiles(rows, [], "value", [0.5]).collect()] == [5.0]
    assert measures.exact_percentiles(rows.limit(0).withColumn("g", F.lit(1)), ["g"], "value", [0.5]).collect() == []


def test_merged_sketches_are_the_whole(spark):
    """Merging keeps the estimate: of parts as of all rows."""
    rows = spark.range(60_000).select((F.col("id") % 20_000).alias("v"), (F.col("id") % 24).alias("hour"))
    merged = measures.merged_estimates(measures.distinct_sketches(rows, [F.col("hour")], "v"), []).first()[0]
    assert abs(merged - 20_000) <= 20_000 * measures.estimate_error()
    assert merged == rows.agg(F.hll_sketch_estimate(F.hll_sketch_agg("v", measures.LG_REGISTERS))).first()[0]


def names(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet") if "data" in p.parts}


def snapshot(spark, rows):
    return sync.with_hash(spark.createDataFrame(rows, "source_id long, description string"), "description")


def test_partial_rewrite(spark, tmp_path):
    folder = str(tmp_path)
    old = [(i, f"text {i}") for i in range(200)]
    sync.write_buckets(snapshot(spark, old), folder, 0, buckets=16)
    before = names(folder)
    new = [(i, f"text {i}") for i in range(3, 200)] + [(500, "new")]
    new[10] = (new[10][0], "changed")
    told = {r.outcome: r.n for r in sync.sync_buckets(snapshot(spark, new), folder, 0).collect()}
    assert told == {"inserted": 1, "updated": 1, "kept": 3, "unchanged": 196}
    after = names(folder)
    assert all(after[n] == t for n, t in before.items())  # no file was changed
    written = {n.split("bucket=")[1].split("/")[0] for n in set(after) - set(before)}
    assert 1 <= len(written) <= 2  # only the buckets of the two changed rows
    rows = lambda v: sorted((r.source_id, r.description) for r in sync.read_buckets(spark, folder, v).collect())
    assert rows(0) == old
    assert rows(1) == sorted({**dict(old), **dict(new)}.items())
    again = {r.outcome: r.n for r in sync.sync_buckets(snapshot(spark, new), folder, 1).collect()}
    assert again == {"kept": 3, "unchanged": 198} and names(folder) == after and rows(2) == rows(1)


def test_first_sync_of_nothing(spark, tmp_path):
    folder = str(tmp_path)
    rows = snapshot(spark, [(1, "a"), (2, None)])
    sync.write_buckets(rows.limit(0), folder, 0, buckets=4)
    assert {r.outcome: r.n for r in sync.sync_buckets(rows, folder, 0).collect()} == {"inserted": 2}
    assert sorted(r.source_id for r in sync.read_buckets(spark, folder, 1, rows.schema).collect()) == [1, 2]


def test_bucketed_join_has_no_exchange(spark):
    mark = uuid.uuid4().hex
    o = tables.bucketed(spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderpriority"), f"o_{mark}", "o_orderkey", 4)
    i = tables.bucketed(spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_quantity"), f"i_{mark}", "l_orderkey", 4)
    out = more.bucketed_totals(o, i)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan and "SelectedBucketsCount: 4 out of 4" in plan
    tables.drop(spark, f"o_{mark}", f"i_{mark}")
    assert not spark.catalog.tableExists(f"o_{mark}")


def test_partitions_are_pruned_by_the_join(spark):
    out = more.events_of_region(spark, SF)
    assert "dynamicpruningexpression" in out._jdf.queryExecution().executedPlan().toString()
    assert {r["name"] for r in out.select("name").distinct().collect()} == {"AFRICA", "AMERICA", "ASIA"}


def test_weighted_median(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 9.0, 5.0), ("b", None, 1.0), ("c", 4.0, None), ("c", 3.0, 2.0)], "g string, v double, w double")
    got = {r.g: r.m for r in rows.groupBy("g").agg(more.weighted_median("v", "w").alias("m")).collect()}
    assert got["a"] == 9.0 and got["c"] == 3.0 and (got["b"] is None or math.isnan(got["b"]))


def test_weighted_medians_of_many_groups(spark, tmp_path):
    """Rows of the SQL, also for nulls, ties and weights of zero; no call of Python for each group, and one shuffle."""
    r = random.Random(11)
    maybe = lambda v: None if r.random() < 0.15 else v
    rows = [(maybe(k), maybe(float(r.randrange(6))), maybe(float(r.choice([0, 1, 1, 2, 7, 50])))) for k in range(300) for _ in range(r.randrange(1, 9))]
    rows += [(1000, None, 3.0), (1000, None, 1.0), (1001, 2.0, None), (1002, 2.0, 0.0), (1002, 1.0, 0.0), (1003, 5.0, 1.0), (1003, None, 9.0), (1004, math.nan, 5.0), (1004, 1.0, 4.0)]
    spark.createDataFrame(rows, "l_partkey long, l_extendedprice double, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    out = more.part_weighted_median(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(map(str, (tuple(x) for x in out.collect()))) == sorted(map(str, c.sql(base.ORACLES["part_weighted_median"]).fetchall()))
    assert "Arrow" not in plan and "Python" not in plan and plan.count("Exchange") == 1
