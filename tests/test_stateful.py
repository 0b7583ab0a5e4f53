"""Streams with state: what they append, what they keep, and what comes too late."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylight.plans import more_queries as more
from quarrylight.streaming import feeds, stateful

SF = "/root/testdata/sf0.001"
END = 4_000_000_000


def events(spark, rows):
    """(event_id, user_id, milliseconds)"""
    raw = spark.createDataFrame(rows, "event_id long, user_id long, ms long")
    return raw.select("event_id", "user_id", F.timestamp_millis("ms").alias("ts"))


def delivered(folder, rows_of, build, closing, **more_arguments):
    return stateful.replay([*rows_of, closing], folder, build, **more_arguments)


def test_debounce_as_stream(spark, tmp_path):
    """Bursts within and over the deliveries, and a user who comes back after the timer has fired."""
    r = random.Random(2)
    at, rows = {u: 10_000 for u in range(4)}, []
    for i in range(300):
        u = r.randrange(4)
        at[u] += r.choice([1, 100, 499, 500, 501, 3000])
        rows.append((i, u, at[u]))
    cuts = [0, 60_000, 120_000, END]
    slices = [events(spark, [x for x in rows if a <= x[2] < b] or [(-9, 9, a)]) for a, b in zip(cuts, cuts[1:], strict=False)]
    kept = []
    with stateful.rocksdb(spark):
        out = delivered(str(tmp_path), slices, lambda source: stateful.debounced(source("rows"), "10 seconds"), events(spark, [(-1, -1, END)]), watch=lambda p: kept.append(p[-1]["stateOperators"][0]["numRowsTotal"]))
    want = feeds.debounce(events(spark, rows), ["user_id"])
    assert sorted(x.event_id for x in out.filter("event_id >= 0").collect()) == sorted(x.event_id for x in want.collect())
    assert kept[-1] <= 2  # the closing row's own state is all that is left


def test_debounce_waits_for_the_quiet(spark, tmp_path):
    """Nothing comes out before the watermark has passed the quiet, and a later event within it replaces the first."""
    told = []
    slices = [events(spark, [(1, 7, 1000)]), events(spark, [(2, 7, 1400), (3, 8, 1400)]), events(spark, [(4, 7, 60_000)])]
    with stateful.rocksdb(spark):
        for n in (1, 2, 3):
            out = stateful.replay(slices[:n], str(tmp_path / str(n)), lambda source: stateful.debounced(source("rows"), "1 second"))
            told.append(sorted(x.event_id for x in out.collect()))
    assert told == [[], [], [2, 3]]


def test_join_state_shrinks(spark, tmp_path):
    """Both sides' rows are dropped as the watermark passes, though every row is delivered and most are found."""
    kept, read = [], []

    def watch(progress):
        last = progress[-1]["stateOperators"]
        kept.append(sum(o["numRowsTotal"] for o in last if "Join" in o["operatorName"] or "join" in o["operatorName"]))
        read.append(sum(p["numInputRows"] for p in progress))

    out = stateful.replay(more.error_view_slices(spark, SF), str(tmp_path), more.errors_after_views, watch)
    e = spark.read.parquet(f"{SF}/events.parquet")
    delivered_rows = e.filter("event_type in ('error', 'view')").count()
    assert sum(read) > delivered_rows  # some twice
    assert 0 < max(kept) < delivered_rows / 4 and kept[-1] <= kept[0] + kept[1]
    assert out.count() == out.distinct().count() > 0


def test_join_plan_has_bounded_state(spark):
    """The batch plan of the same join has no nested loop."""
    slices = more.error_view_slices(spark, SF)[0]
    plan = stateful.interval_join(slices["errors"], slices["views"], ["user_id"], "6 HOURS", "error_ts", "view_ts")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_copies_within_the_watermark(spark, tmp_path):
    rows = events(spark, [(1, 1, 1000), (1, 1, 1000), (2, 1, 1500), (1, 1, 1200)])
    out = stateful.replay([rows, events(spark, [(2, 1, 1500), (3, 1, 2000)])], str(tmp_path), lambda source: stateful.once(source("rows"), ["event_id"], "1 minute"))
    assert sorted(x.event_id for x in out.collect()) == [1, 2, 3]


@pytest.mark.parametrize("gap", [500, 60_000])
def test_sessions(spark, gap):
    r = random.Random(gap)
    rows = [(i, r.randrange(5), r.randrange(400_000)) for i in range(150)] + [(200, 1, 1000), (201, 1, 1000 + gap), (202, 4, 500_000), (203, 4, 500_001 + gap)]
    want = []
    for u in range(5):
        run = []
        for ms in sorted(x[2] for x in rows if x[1] == u):
            if run and ms - run[-1] > gap:
                want.append((u, run[0], run[-1], len(run)))
                run = []
            run.append(ms)
        want.append((u, run[0], run[-1], len(run)))
    got = stateful.sessions(events(spark, rows), ["user_id"], f"{gap} milliseconds").select("user_id", F.unix_millis("first_ts"), F.unix_millis("last_ts"), "events")
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)


def test_session_merges_over_deliveries(spark, tmp_path):
    """A late row joins two sessions that were apart."""
    slices = [events(spark, [(1, 1, 0), (2, 1, 90_000)]), events(spark, [(3, 1, 45_000)]), events(spark, [(-1, -1, END)])]
    out = stateful.replay(slices, str(tmp_path), lambda source: stateful.sessions(source("rows"), ["user_id"], "1 minute", delay="10 minutes"))
    assert [(x.user_id, x.events) for x in out.collect()] == [(1, 3)]


def test_late_rows_are_apart(spark, tmp_path):
    day = 86_400_000
    slices = [events(spark, [(1, 1, 1000), (2, 1, 3 * day)]), events(spark, [(3, 1, 2000), (4, 1, 2 * day + 5), (5, 1, 6 * day)])]
    seen = []
    done = stateful.replay(slices, str(tmp_path), lambda source: stateful.finalized_counts(source("rows"), ["user_id"], "1 day", "12 hours"), seen.extend)
    until = F.lit(max(p["eventTime"]["watermark"] for p in seen if "watermark" in p["eventTime"])).cast("timestamp")
    told = stateful.late_counts(slices[0].unionByName(slices[1]), done, ["user_id"], "1 day", until)
    got = sorted((x.window_start.day, x.on_time, x.late) for x in told.collect())
    # Day 3 had not come out when its second row came; the first day had.
    assert got == [(1, 1, 1), (3, 1, 0), (4, 1, 0)]


def test_restored_setting(spark):
    before = spark.conf.get(stateful.STORE_SETTING)
    with stateful.rocksdb(spark):
        assert spark.conf.get(stateful.STORE_SETTING) == stateful.ROCKSDB
    assert spark.conf.get(stateful.STORE_SETTING) == before


def test_sources_fail_apart(spark):
    """A source that can't be opened and one whose rows can't be computed fall back; the third is fresh; replacing runs at a time."""
    import threading

    ok = spark.range(3)
    meeting = threading.Barrier(3, timeout=60)
    kept = {}

    def replace(name, rows):
        if name not in kept:
            kept[name] = None
            meeting.wait()
        kept[name] = len(rows.collect())

    def broken():
        meeting.wait()
        kept["gone"] = None
        return spark.read.parquet("/no/such/place")

    sources = {"ok": lambda: ok, "late": lambda: ok.select(F.raise_error(F.lit("no")).alias("id")), "gone": broken}
    told = feeds.refresh_sources(sources, {n: ok.limit(1) for n in sources}, replace)
    assert {r.source: r.fresh for r in told.collect()} == {"ok": True, "late": False, "gone": False}
    assert kept == {"ok": 3, "late": 1, "gone": 1}
