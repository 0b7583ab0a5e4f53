"""Hand-made cases with known results."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quarrylight import schemas
from quarrylight.functions import scalars as X
from quarrylight.operators import catalog, feeds, sync
from quarrylight.plans import monitoring, support, trace
from quarrylight.sources import readers, writers
from quarrylight.streaming import feeds as live


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x"))).first()[0]


def test_entry_and_contract(spark):
    assert __spark_entry__.entry(spark).columns == ["id", "title", "category", "views"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize(("raw", "out"), [(" a ", "a"), ("\t\n 　x ", "x"), ("\t", ""), ("a b", "a b")])
def test_strip(spark, raw, out):
    assert one(spark, raw, X.strip) == out


def test_small_scalars(spark):
    assert one(spark, "a b&c'(é)~!*", X.url_component) == "a%20b%26c'(%C3%A9)~!*"
    assert one(spark, None, X.is_blank) is True
    assert one(spark, "", lambda c: X.or_else(c, F.lit("User"))) == "User"
    assert one(spark, None, lambda c: X.json_or_empty(F.lit(None).cast("map<string,string>"))) == "{}"
    assert one(spark, "2024-01-02T03:04:05.678Z", lambda c: X.iso_utc(X.from_iso(c))) == "2024-01-02T03:04:05.678Z"
    assert one(spark, "no time", X.from_iso) is None
    assert one(spark, "Hi hi, THERE", X.terms) == ["hi", "there"]


@pytest.mark.parametrize(("n", "pages"), [(0, 0), (1, 1), (10, 1), (11, 2)])
def test_pages(spark, n, pages):
    rows = spark.createDataFrame([(f"{i:03d}", "t%_", "c") for i in range(n)], "id string, title string, category string")
    p = catalog.pagination(rows, 1, 10).first()
    assert (p.total_pages, p.has_next_page, p.previous_page, p.next_page) == (pages, pages > 1, None, 2 if pages > 1 else None)
    past = catalog.pagination(rows, 9, 10).first()
    assert past.has_next_page is False and catalog.page(rows, 9, 10).count() == 0
    assert [r.id for r in catalog.page(rows, 2, 10).collect()] == [f"{i:03d}" for i in range(10, n)]
    assert catalog.matching(rows, "%_").count() == n and catalog.matching(rows, "x%").count() == 0 and catalog.matching(rows, "  ").count() == n


def test_page_size(spark):
    with pytest.raises(ValueError):
        catalog.page(spark.range(1), 1, 0)


def test_links_and_references(spark):
    refs = spark.createDataFrame([("7", None), ("7", ""), ("7", "/u"), (None, None)], "related_article string, related_article_url string")
    assert [r.link for r in catalog.link_target(refs).collect()] == ["/article/7", "/article/7", "/u", None]
    known = spark.createDataFrame([("7", "T")], "id string, title string")
    assert sorted(str(r.article_title) for r in catalog.with_article(refs, known).collect()) == ["None", "T", "T", "T"]


def test_feeds(spark):
    feed = spark.createDataFrame([(i, "2024-01-01 00:00:00", i % 2 == 0) for i in range(5)], "id int, timestamp string, read boolean")
    assert [r.id for r in feeds.newest(feed, 3).orderBy("position").collect()] == [4, 3, 2]
    once = feeds.mark_read(feed, F.col("id") == 1)
    assert once.collect() == feeds.mark_read(once, F.col("id") == 1).collect()
    assert feeds.mark_read(feed, F.col("id") == 99).collect() == feed.collect()
    assert feeds.unread_count(feed).first().unread == 2 and feeds.unread_count(feeds.mark_read(feed)).first().has_unread is False
    assert feeds.cleared(feed).count() == 0


def test_sync_twice_changes_nothing(spark, tmp_path):
    make = lambda rows: sync.with_hash(spark.createDataFrame(rows, "source_id string, description string"), "description")
    writers.write_version(make([("a", "1"), ("b", "2"), ("k", None)]).withColumn("outcome", F.lit("")), str(tmp_path), 0)
    source = make([("a", "1"), ("b", "3"), ("c", "4")])
    assert dict(sync.run_sync(source, str(tmp_path), 0).collect()) == {"unchanged": 1, "updated": 1, "inserted": 1, "kept": 1}
    assert dict(sync.run_sync(source, str(tmp_path), 1).collect()) == {"unchanged": 3, "kept": 1}
    rows = {r.source_id: r.description for r in writers.read_version(spark, str(tmp_path), 2).collect()}
    assert rows == {"a": "1", "b": "3", "c": "4", "k": None}
    current = make([("a", "1")]).withColumn("active", F.lit(None).cast("boolean"))
    assert catalog.active(sync.deactivate(current, source)).count() == 0
    assert sync.delete(current, source).count() == 0


def test_retrieval(spark):
    arts = spark.createDataFrame([(1, "reset the router now"), (2, "reset password"), (3, "")], "id int, text string")
    ask = spark.createDataFrame([(1, "Reset the router"), (2, "  "), (3, "unknown words"), (4, None)], "query_id int, query string")
    found = support.retrieve(ask, arts).collect()
    assert [(r.query_id, r.id, r.confidence, r["rank"]) for r in found] == [(1, 1, 1.0, 1)]
    assert support.answers(ask, arts).first().answer == "reset the router now"
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    assert support.retrieve(ask, arts).collect() == found
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    records = {r.subject: r.outcome for r in trace.of_queries(ask, support.retrieve(ask, arts)).collect()}
    assert records == {"1": "answered", "2": "no answer", "3": "no answer", "4": "no answer"}


RULES = [("disk", "disk full", "CRITICAL", "d", "free space", "9"), ("slow", "slow", "WARNING", "s", "wait", None)]


def test_logs(spark, tmp_path):
    files = {"clean.log": "2024-01-01 00:00:00 INFO all well\n", "warn.log": "2024-01-01 00:00:00 WARN slow call\nnot a log line\n", "bad.log": "2024-01-01T00:00:01Z [ERROR] - disk full\n2024-01-01 00:00:02 INFO slow\n", "empty.log": ""}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    paths = [str(tmp_path / n) for n in files] + [str(tmp_path / "missing.log")]
    lines, status = readers.read_logs(spark, paths)
    assert {r.file.rsplit("/", 1)[1]: r.file_status for r in status.collect()} == {**dict.fromkeys(files, "read"), "missing.log": "inaccessible"}
    found = monitoring.issues(lines, RULES)
    result = monitoring.status(found, status.filter("file_status = 'read'"))
    by = {r.file.rsplit("/", 1)[1]: (r.status, r.issues) for r in result.collect()}
    assert by == {"clean.log": ("OK", 0), "warn.log": ("WARNING", 1), "bad.log": ("CRITICAL", 2), "empty.log": ("OK", 0)}
    assert sorted(r.type for r in monitoring.notifications(result).collect()) == ["error", "warning"]
    counts = {r.file.rsplit("/", 1)[1]: (r.lines, r.unparsed) for r in monitoring.line_counts(lines).collect()}
    assert counts["warn.log"] == (2, 1) and counts["bad.log"] == (2, 0)
    with pytest.raises(ValueError):
        readers.read_logs(spark, ["x"] * 11)


def test_levels_and_anomalies_give_the_status(spark):
    """Lines of level WARN or ERROR that no rule matches, and an hour with far more lines than usual."""
    quiet = [("busy", h, f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00", "INFO", "x") for h in range(30)]
    rush = [("busy", 100 + n, "2024-01-03 00:00:00", "INFO", "x") for n in range(50)]
    rows = [("clean", 1, "2024-01-01 00:00:00", "INFO", "well"), ("warn", 1, "2024-01-01 00:00:00", "WARN", "odd"), ("err", 1, "2024-01-01 00:00:00", "ERROR", "odd"), ("raw", 1, None, None, "not parsed")]
    lines = spark.createDataFrame(rows + quiet + rush, "file string, line_no long, ts string, level string, message string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.file: (r.status, r.issues) for r in monitoring.status(monitoring.findings(lines, RULES), lines).collect()}
    assert got == {"clean": ("OK", 0), "warn": ("WARNING", 1), "err": ("CRITICAL", 1), "raw": ("OK", 0), "busy": ("WARNING", 1)}
    placed = monitoring.positions(lines).collect()
    assert sorted(r.position for r in placed if r.file == "busy") == list(range(80)) and len(placed) == len(rows) + 80


def test_titles_and_keywords_are_scored(spark):
    arts = spark.createDataFrame([(1, "Router", ["reset"], "now"), (2, None, None, "reset"), (3, "router", ["x"], None)], "id int, title string, keywords array<string>, text string")
    ask = spark.createDataFrame([(1, "reset router")], "query_id int, query string")
    assert [(r.id, r.confidence) for r in support.retrieve(ask, arts).collect()] == [(1, 1.0)]
    assert [(r.id, r.confidence) for r in support.retrieve(ask, arts, 0.5).orderBy("rank").collect()] == [(1, 1.0), (2, 0.5), (3, 0.5)]


def test_lookup_reaches_the_scan(spark):
    from quarrylight.plans.queries import kb_article_lookup

    plan = kb_article_lookup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,5)" in plan


def test_lines_of_split_files(spark, tmp_path):
    text = "".join(f"2024-01-01 00:00:00 INFO line {n}\n" for n in range(5000))
    (tmp_path / "a.log").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines, _ = readers.read_logs(spark, [str(tmp_path / "a.log")])
        assert lines.rdd.getNumPartitions() >= 1
        assert {r.line_no: r.message for r in lines.collect()} == {n + 1: f"line {n}" for n in range(5000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_nested_payload(spark):
    row = ("OK", "read", ("1 kB", "today"), [("i1", "WARNING", "p", "t", "d", "a", None, None)], [("t2", "INFO", "b"), ("t1", "ERROR", "a")])
    analyses = spark.createDataFrame([row], schemas.LOG_ANALYSIS)
    assert [(r.position, r.level) for r in monitoring.unnest_events(analyses).collect()] == [(0, "INFO"), (1, "ERROR")]
    assert monitoring.unnest_issues(analyses).first().severity == "WARNING" and monitoring.file_info(analyses).first().size == "1 kB"


def test_entities_and_pages(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id":"1","type":"view","timestamp":"2024-01-01T00:00:00Z"}\n{"id":"2","type":"odd"}\nnot json\n{"type":"view"}\n')
    good, bad = readers.read_entities(spark, str(tmp_path / "a.json"), schemas.ACTIVITY, {"type": schemas.ACTIVITY_TYPES})
    assert [r.id for r in good.collect()] == ["1"] and sorted(r.reason for r in bad.collect()) == ["corrupt record", "no id", "unknown type"]
    schema = schemas.page_of(schemas.NOTIFICATION)
    assert one(spark, '{"pagination":{}}', lambda c: F.size(readers.page_items(c, schema))) == 0
    assert one(spark, '{"items":[{"id":"1"}]}', lambda c: F.size(readers.page_items(c, schema))) == 1


def test_slots(spark):
    slots = spark.createDataFrame([(0, "a"), (1, None)], "slot int, path string")
    assert readers.chosen_files(slots).count() == 1
    with pytest.raises(ValueError):
        readers.chosen_files(slots.filter("path is null"))
    kept = spark.range(1).select(readers.without_slot(F.array(F.lit("a"), F.lit("b")), 0)).first()[0]
    assert kept == ["b"]


def test_export_and_trace(spark, tmp_path):
    feed = spark.createDataFrame([("1", {"k": "v"})], "id string, metadata map<string,string>")
    writers.export_log(feed, str(tmp_path / "csv"), "csv")
    writers.export_log(feed, str(tmp_path / "json"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().metadata == '{"k":"v"}'
    records = trace.of_runs(spark.createDataFrame([("f", "OK")], "file string, status string"))
    writers.append_trace(records, str(tmp_path / "t"))
    writers.append_trace(records, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_debounce_and_latest(spark):
    rows = spark.createDataFrame([(1, "a", 0.0), (2, "a", 0.4), (3, "a", 1.0), (4, "b", 0.0)], "event_id int, k string, s double").withColumn("ts", F.timestamp_millis((F.col("s") * 1000).cast("long")))
    assert sorted(r.event_id for r in live.debounce(rows, ["k"]).collect()) == [2, 3, 4]
    assert sorted(r.event_id for r in live.latest(rows, ["k"], "ts").collect()) == [3, 4]


def test_failed_refresh_keeps_the_last_snapshot(spark, tmp_path):
    events = spark.createDataFrame([(1, "view")], "event_id int, event_type string").withColumn("ts", F.current_timestamp())
    events.write.parquet(str(tmp_path / "in"))
    failures = []

    def broken(df, batch):
        raise OSError("down")

    stream = live.stream_of(spark, str(tmp_path / "in"), events.schema)
    live.refresh(live.snapshot_counts(stream), broken, str(tmp_path / "state"), once=True, failed=lambda b, e: failures.append(str(e))).awaitTermination()
    assert failures and set(failures) == {"down"}
