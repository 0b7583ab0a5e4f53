"""As-of and range joins against plain loops, and their plans."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import temporal
from quarrylight.plans import more_queries


def left_of(spark, rows):
    return spark.createDataFrame(rows, "k string, us long, l long").select("k", F.timestamp_micros("us").alias("lt"), "l")


def right_of(spark, rows):
    return spark.createDataFrame(rows, "k string, us long, r long").select("k", F.timestamp_micros("us").alias("rt"), "r")


@pytest.mark.parametrize("bucket", [7, 100, 10**9])
@pytest.mark.parametrize("within", [None, 40])
def test_asof(spark, bucket, within):
    r = random.Random(bucket)
    left = [(r.choice("aaaab"), r.randrange(-300, 1000), i) for i in range(80)] + [("c", 5, 900), (None, 5, 901), ("a", None, 902), ("a", 5, 903), ("a", 5, 903)]
    right = [(r.choice("aab"), r.randrange(-300, 1000), i) for i in range(60)] + [(None, 4, 70), ("a", None, 71), ("d", 1, 72), ("a", 5, 73), ("a", 5, 74)]
    want = []
    for k, us, i in left:
        best = max(((u, x) for q, u, x in right if k is not None and us is not None and q == k and u is not None and u <= us), default=None)
        if best and within is not None and us - best[0] > within:
            best = None
        want.append((i, best[1] if best else None))
    got = temporal.asof_join(left_of(spark, left), right_of(spark, right), ["k"], "lt", "rt", "r", within_us=within, bucket_us=bucket)
    assert got.columns == ["k", "lt", "l", "rt", "r"]
    assert sorted(map(str, ((x.l, x.r) for x in got.collect()))) == sorted(map(str, want))


def test_asof_empty_sides(spark):
    one = left_of(spark, [("a", 1, 1)])
    nothing = right_of(spark, [("a", 1, 1)]).limit(0)
    assert [(x.l, x.r) for x in temporal.asof_join(one, nothing, ["k"], "lt", "rt", "r").collect()] == [(1, None)]
    assert temporal.asof_join(one.limit(0), right_of(spark, [("a", 1, 1)]), ["k"], "lt", "rt", "r").collect() == []


def test_asof_spreads_a_hot_key(spark):
    """One key with everything: the window is dealt by key and bucket, not by key alone."""
    plan = temporal.asof_join(left_of(spark, [("a", 1, 1)]), right_of(spark, [("a", 1, 1)]), ["k"], "lt", "rt", "r")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    windows = [x for x in plan.splitlines() if "Window [last(" in x and "_side" in x]
    assert windows and all("_bucket" in x for x in windows)


@pytest.mark.parametrize("bin_us", [1, 10, 1000])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_range(spark, bin_us, keys):
    r = random.Random(bin_us)
    points = [(r.choice("ab"), r.randrange(-500, 500), i) for i in range(60)] + [("a", None, 99), ("a", 7, 100), ("a", 7, 100)]
    ranges = []
    for i in range(50):
        a = r.randrange(-500, 500)
        ranges.append((r.choice("ab"), a, a + r.choice([0, 1, 2, 3, 16, 17, 300, 5000, -4]), i))
    ranges += [("a", None, 5, 60), ("a", 5, None, 61)]
    p = spark.createDataFrame(points, "k string, us long, p long").select("k", F.timestamp_micros("us").alias("ts"), "p")
    g = spark.createDataFrame(ranges, "k string, a long, b long, g long").select(F.col("k").alias("k" if keys else "gk"), F.timestamp_micros("a").alias("a"), F.timestamp_micros("b").alias("b"), "g")
    out = temporal.range_join(p, g, "ts", "a", "b", keys, bin_us=bin_us)
    want = [(x, y) for k, us, x in points for q, a, b, y in ranges if None not in (us, a, b) and a <= us < b and (not keys or k == q)]
    assert sorted((x.p, x.g) for x in out.collect()) == sorted(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortMergeJoin" in plan


def test_long_ranges_are_not_cut_into_many(spark):
    """A range of a century meets three bins of its level at most."""
    g = spark.createDataFrame([(1, 0, 3 * 10**15)], "g long, a long, b long").select("g", F.timestamp_micros("a").alias("a"), F.timestamp_micros("b").alias("b"))
    p = spark.createDataFrame([(1, 5), (2, 3 * 10**15 - 1), (3, 3 * 10**15)], "p long, us long").select("p", F.timestamp_micros("us").alias("ts"))
    out = temporal.range_join(p, g, "ts", "a", "b", bin_us=1000)
    assert sorted(x.p for x in out.collect()) == [1, 2]
    assert temporal.range_join(p, g.limit(0), "ts", "a", "b").collect() == []


def test_crowded_hours_meet_as_hours(spark, tmp_path):
    """Hours with hundreds of events: the join reads a row for each hour, not the events."""
    r = random.Random(3)
    day = datetime.datetime(2024, 1, 1)
    moments = [day + datetime.timedelta(hours=h, seconds=r.randrange(3600)) for h in (0, 1, 2, 5, 400, 401, 2000) for _ in range({1: 1, 5: 600, 401: 3}.get(h, 400))]
    moments += [day + datetime.timedelta(hours=2), day + datetime.timedelta(hours=3) - datetime.timedelta(microseconds=1), None]
    ids = r.sample(range(10_000), len(moments))
    rows = spark.createDataFrame(list(zip(ids, moments, strict=True)), "event_id long, ts timestamp_ntz")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    out = more_queries.events_during_anomalies(spark, str(tmp_path))
    want = set()
    hour = lambda t: t.replace(minute=0, second=0, microsecond=0)
    for a in {hour(t) for t in moments if t}:
        b = a + datetime.timedelta(hours=sum(t is not None and hour(t) == a for t in moments))
        held = [i for i, t in zip(ids, moments, strict=True) if t and a <= t < b]
        want.add((a.strftime("%Y-%m-%d %H"), len(held), min(held)))
    assert {tuple(x) for x in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "event_id" not in plan
