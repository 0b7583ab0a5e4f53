"""Queries over the supplied tables, each with its DuckDB twin.

The tables hold none of the product's entities, so they stand in for them by shape: documents for articles
(id, title = source, category = lang, description = text, steps = lines), events for activities, notifications and
log lines, benchmark and user turns for support queries, labelled documents for what was synchronized before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.functions import maps
from quarrylight.functions import scalars as X
from quarrylight.operators import catalog, feeds, sync
from quarrylight.plans import monitoring, support, trace
from quarrylight.sources import readers
from quarrylight.sources.readers import split_valid
from quarrylight.sources.writers import export_log, shared_folder, write_version
from quarrylight.streaming import feeds as live


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark, d) -> DataFrame:
    return as_articles(_read(spark, d, "documents"))


def as_articles(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.col("lang").alias("category"), F.col("text").alias("description"), F.col("n_chars").alias("views"), F.split("text", "\n").alias("resolution_steps"))


ACTIVITY_OF = {"error": "alert", "view": "view", "click": "search"}
LEVEL_OF = {"error": "ERROR", "signup": "WARN"}


def _case(column, arms, other):
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in arms.items() for x in kv)), column), F.lit(other))


def activities(spark, d) -> DataFrame:
    e = _read(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"), _case(F.col("event_type"), ACTIVITY_OF, "system").alias("type"),
        F.col("event_type").alias("message"), F.col("user_id").cast("string").alias("user"), F.from_json("props", "map<string,string>").alias("metadata"),
    )


def notifications(spark, d) -> DataFrame:
    """Error events; the read flag is made up, as no table has one."""
    e = _read(spark, d, "events").filter("event_type = 'error'")
    return e.select(F.col("event_id").alias("id"), F.lit("Error").alias("title"), F.col("props").alias("message"), F.col("ts").cast("timestamp").alias("timestamp"), (F.col("event_id") % 2 == 0).alias("read"), F.lit("error").alias("type"))


def log_lines(spark, d) -> DataFrame:
    e = _read(spark, d, "events")
    return e.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("file"), F.col("event_id").alias("line_no"), F.col("ts").cast("timestamp").alias("ts"), _case(F.col("event_type"), LEVEL_OF, "INFO").alias("level"), F.concat_ws(" ", "event_type", "props").alias("message"))


RULES = [
    ("failure", "^error", "CRITICAL", "A step failed", "Look at the event", "1"),
    ("high-k", '"k": 9[0-9]', "WARNING", "A value is near its limit", "Watch it", "2"),
]


def _asked(spark, d) -> DataFrame:
    return _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _library(spark, d) -> DataFrame:
    return _read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("title"))


def _references(spark, d) -> DataFrame:
    """Labels as answers that refer to articles: with a URL, with an empty one, or with none."""
    url = F.when(F.col("toxic") == 1, F.concat(F.lit("/kb/"), F.col("doc_id").cast("string"))).when(F.col("quality") == 1, "")
    return _read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("related_article"), url.alias("related_article_url"))


def _source(spark, d) -> DataFrame:
    return sync.with_hash(_read(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.col("text").alias("description")), "description")


def _current(spark, d) -> DataFrame:
    """What was synchronized before: the labelled documents, those of quality 0 with another text."""
    labelled = _read(spark, d, "labels").select(F.col("doc_id").alias("source_id"), "quality")
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.col("text").alias("description")).join(labelled, "source_id")
    old = F.when(F.col("quality") == 0, F.concat(F.lit("old "), F.coalesce("description", F.lit("")))).otherwise(F.col("description"))
    return sync.with_hash(docs.select("source_id", old.alias("description")), "description")


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


_ACT = "CASE event_type WHEN 'error' THEN 'alert' WHEN 'view' THEN 'view' WHEN 'click' THEN 'search' ELSE 'system' END"
_LVL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END"
_HIT = "(contains(lower(CAST(doc_id AS VARCHAR)), 'fr') OR contains(lower(source), 'fr') OR contains(lower(lang), 'fr'))"
_META = """CASE WHEN props IS NULL THEN '{}' ELSE '{"k":"' || json_extract_string(props, '$.k') || '"}' END"""
_WORDS = "list_filter(list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+')), lambda t : t <> '')"


@_query("kb_search_page", f"SELECT CAST(doc_id AS VARCHAR) AS id, source AS title, lang AS category, n_chars AS views FROM documents WHERE {_HIT} ORDER BY id LIMIT 10 OFFSET 10")
def kb_search_page(spark, d):
    return catalog.list_rows(catalog.page(catalog.matching(articles(spark, d), "FR"), 2, 10))


@_query("kb_pagination", f"SELECT CAST(2 AS BIGINT) AS current_page, CAST(10 AS BIGINT) AS page_size, n AS total_items, p AS total_pages, 2 < p AS has_next_page, true AS has_previous_page, CASE WHEN 2 < p THEN CAST(3 AS BIGINT) END AS next_page, CAST(1 AS BIGINT) AS previous_page FROM (SELECT count(*) AS n, CAST(ceil(count(*) / 10.0) AS BIGINT) AS p FROM documents WHERE {_HIT}) AS x")
def kb_pagination(spark, d):
    return catalog.pagination(catalog.matching(articles(spark, d), "FR"), 2, 10)


@_query("kb_article_lookup", "SELECT CAST(doc_id AS VARCHAR) AS id, source AS title, lang AS category, text AS description, n_chars AS views FROM documents WHERE doc_id = 5")
def kb_article_lookup(spark, d):
    return as_articles(catalog.lookup(_read(spark, d, "documents"), 5, "doc_id")).drop("resolution_steps")


@_query("kb_article_detail", "SELECT CAST(doc_id AS VARCHAR) AS id, source AS title, lang AS category, text AS description, CAST(len(string_split(text, chr(10))) AS BIGINT) AS steps FROM documents")
def kb_article_detail(spark, d):
    rows = articles(spark, d).withColumn("last_updated", F.lit(None).cast("string"))
    return catalog.detail_rows(rows).select("id", "title", "category", "description", F.size("resolution_steps").cast("long").alias("steps"))


@_query("steps_in_order", "SELECT CAST(doc_id AS VARCHAR) AS id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS position, unnest(string_split(text, chr(10))) AS step FROM documents")
def steps_in_order(spark, d):
    return catalog.steps(articles(spark, d))


def _top(n, where="true"):
    return f"SELECT event_id AS id, CAST(row_number() OVER (ORDER BY ts DESC, event_id DESC) AS BIGINT) AS position FROM events WHERE {where} ORDER BY ts DESC, event_id DESC LIMIT {n}"


@_query("activity_feed_top4", _top(4))
def activity_feed_top4(spark, d):
    return feeds.newest(activities(spark, d), 4).select("id", "position")


@_query("alerts_top3", _top(3, "event_type = 'error'"))
def alerts_top3(spark, d):
    return feeds.newest(notifications(spark, d), 3).select("id", "position")


@_query("activity_rows", f"SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown_at, event_type AS message, CAST(user_id AS VARCHAR) AS \"user\", upper({_ACT}) AS type, CASE {_ACT} WHEN 'alert' THEN 'error' WHEN 'system' THEN 'warning' WHEN 'search' THEN 'default' ELSE 'success' END AS class, {_META} AS details FROM events")
def activity_rows(spark, d):
    return feeds.activity_rows(activities(spark, d))


@_query("notification_rows", "SELECT event_id AS id, 'Error' AS title, props AS message, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown_at, 'error' AS type, event_id % 2 = 0 AS read FROM events WHERE event_type = 'error'")
def notification_rows(spark, d):
    return feeds.notification_rows(notifications(spark, d))


@_query("activity_class", f"SELECT event_id, upper({_ACT}) AS type, CASE {_ACT} WHEN 'alert' THEN 'error' WHEN 'system' THEN 'warning' WHEN 'search' THEN 'default' ELSE 'success' END AS class, CASE {_ACT} WHEN 'alert' THEN 'error' WHEN 'system' THEN 'warning' ELSE 'success' END AS dashboard FROM events")
def activity_class(spark, d):
    a = activities(spark, d)
    return a.select(F.col("id").alias("event_id"), F.upper("type").alias("type"), maps.activity_class(F.col("type")).alias("class"), maps.dashboard_class(F.col("type")).alias("dashboard"))


@_query("activity_search", f"SELECT event_id AS id FROM events WHERE contains(event_type, 'pur') OR contains(CAST(user_id AS VARCHAR), 'pur') OR contains({_META}, 'pur')")
def activity_search(spark, d):
    return feeds.search_feed(activities(spark, d), "PUR").select("id")


@_query("activity_filter", f"SELECT event_id AS id FROM events WHERE {_ACT} IN ('alert', 'view')")
def activity_filter(spark, d):
    return feeds.of_types(activities(spark, d), "alert", "view").select("id")


@_query("activity_metadata_json", f"SELECT event_id AS id, {_META} AS details FROM events")
def activity_metadata_json(spark, d):
    return activities(spark, d).select("id", X.json_or_empty(F.col("metadata")).alias("details"))


_STATUS = f"CASE {_LVL} WHEN 'ERROR' THEN 'CRITICAL' WHEN 'WARN' THEN 'WARNING' ELSE 'OK' END"


@_query("notification_type_map", f"SELECT event_id, {_STATUS} AS status, CASE {_STATUS} WHEN 'CRITICAL' THEN 'error' ELSE 'warning' END AS type, CASE {_STATUS} WHEN 'WARNING' THEN 'warning' ELSE 'error' END AS issue_class FROM events")
def notification_type_map(spark, d):
    status = _case(F.col("level"), {"ERROR": "CRITICAL", "WARN": "WARNING"}, "OK")
    rows = log_lines(spark, d).select(F.col("line_no").alias("event_id"), status.alias("status"))
    return rows.select("event_id", "status", maps.notification_type(F.col("status")).alias("type"), maps.issue_class(F.col("status")).alias("issue_class"))


@_query("event_level_map", f"SELECT event_id, {_LVL} AS level, CASE {_LVL} WHEN 'ERROR' THEN 'error' WHEN 'WARN' THEN 'warning' ELSE 'default' END AS class FROM events")
def event_level_map(spark, d):
    return log_lines(spark, d).select(F.col("line_no").alias("event_id"), "level", maps.level_class(F.col("level")).alias("class"))


@_query("unread_count", "SELECT count(*) FILTER (event_id % 2 <> 0) AS unread, count(*) FILTER (event_id % 2 <> 0) > 0 AS has_unread FROM events WHERE event_type = 'error'")
def unread_count(spark, d):
    return feeds.unread_count(notifications(spark, d))


@_query("unread_on_page", "SELECT count(*) FILTER (event_id % 2 <> 0) AS unread, count(*) FILTER (event_id % 2 <> 0) > 0 AS has_unread FROM (SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 10) AS p")
def unread_on_page(spark, d):
    return feeds.unread_count(feeds.newest(notifications(spark, d), 10))


_STATS = "SELECT (SELECT count(*) FROM conversations WHERE role = 'user') AS supportQueries, (SELECT count(*) FROM events) AS activeLogs, (SELECT count(*) FROM events WHERE event_type = 'error') AS detectedIssues, (SELECT count(*) FROM documents) AS kbArticles"


@_query("system_stats", _STATS)
def system_stats(spark, d):
    return feeds.stats(_read(spark, d, "conversations").filter("role = 'user'"), _read(spark, d, "events"), F.col("event_type") == "error", _read(spark, d, "documents"))


@_query("stats_cards", f"WITH s AS ({_STATS}) SELECT 'Support Queries' AS label, CAST(supportQueries AS VARCHAR) AS value FROM s UNION ALL SELECT 'Active Logs', CAST(activeLogs AS VARCHAR) || ' Logs' FROM s UNION ALL SELECT 'Detected Issues', CAST(detectedIssues AS VARCHAR) FROM s UNION ALL SELECT 'KB Articles', CAST(kbArticles AS VARCHAR) FROM s")
def stats_cards(spark, d):
    return feeds.stats_cards(system_stats(spark, d))


@_query("stats_merge", f"WITH s AS ({_STATS}) SELECT supportQueries, activeLogs + 3 AS activeLogs, detectedIssues, kbArticles FROM s")
def stats_merge(spark, d):
    base = system_stats(spark, d)
    return feeds.merge_stats(base, base.select((F.col("activeLogs") + 3).alias("activeLogs"), F.lit(None).cast("long").alias("detectedIssues")))


@_query("mark_read", "SELECT event_id AS id, event_id % 2 = 0 OR CAST(user_id AS VARCHAR) = '7' AS read FROM events WHERE event_type = 'error'")
def mark_read(spark, d):
    owner = _read(spark, d, "events").select(F.col("event_id").alias("id"), "user_id")
    return feeds.mark_read(notifications(spark, d).join(owner, "id"), F.col("user_id") == 7).select("id", "read")


@_query("mark_all_read", "SELECT event_id AS id, true AS read FROM events WHERE event_type = 'error'")
def mark_all_read(spark, d):
    return feeds.mark_read(notifications(spark, d)).select("id", "read")


@_query("clear_all", "SELECT event_id AS id FROM events WHERE false")
def clear_all(spark, d):
    return feeds.cleared(notifications(spark, d)).select("id")


@_query("insert_notification", "SELECT CAST(event_id AS VARCHAR) AS id, props AS message, event_id % 2 = 0 AS read FROM events WHERE event_type = 'error' UNION ALL SELECT substr(sha256('New' || chr(31) || 'sign-up'), 1, 9), 'sign-up', false")
def insert_notification(spark, d):
    feed = notifications(spark, d).select(F.col("id").cast("string").alias("id"), "title", "message", "read")
    row = spark.createDataFrame([("New", "sign-up")], "title string, message string")
    return feeds.insert(feed, row, read=False).select("id", "message", "read")


@_query("counters", f"SELECT CAST(sum(files) AS BIGINT) AS \"activeLogs\", CAST(sum(issues) AS BIGINT) AS \"detectedIssues\", count(*) AS runs FROM (SELECT user_id, count(*) AS files, count(*) FILTER ({_LVL} = 'ERROR') AS issues FROM events GROUP BY user_id) AS r")
def counters(spark, d):
    runs = log_lines(spark, d).groupBy("file").agg(F.count("*").alias("files"), F.count_if(F.col("level") == "ERROR").alias("issues"))
    return feeds.counters(runs)


@_query("link_target", "SELECT CAST(doc_id AS VARCHAR) AS related_article, CASE WHEN toxic = 1 THEN '/kb/' || doc_id ELSE '/article/' || doc_id END AS link FROM labels")
def link_target(spark, d):
    return catalog.link_target(_references(spark, d)).select("related_article", "link")


@_query("display_name", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'User' ELSE 'user ' || doc_id END AS name FROM labels")
def display_name(spark, d):
    named = _read(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 0, F.concat(F.lit("user "), F.col("doc_id").cast("string"))).otherwise("").alias("name"))
    return named.select("doc_id", X.or_else(F.col("name"), F.lit("User")).alias("name"))


@_query("blank_query_guard", r"SELECT conv_id, turn, text AS query FROM conversations WHERE role = 'user' AND regexp_matches(coalesce(text, ''), '[^\s\p{Z}]')")
def blank_query_guard(spark, d):
    return catalog.asked(_read(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("query")))


@_query("query_url", "SELECT item_id AS query_id, url_encode(text) AS encoded FROM benchmark")
def query_url(spark, d):
    # DuckDB also keeps ~ but encodes ! ' ( ) *, which don't stand in these texts
    return _asked(spark, d).select("query_id", X.url_component(F.col("query")).alias("encoded"))


@_query("iso_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown FROM events")
def iso_timestamps(spark, d):
    iso = _read(spark, d, "events").select("event_id", X.iso_utc(F.col("ts")).alias("iso"))
    return iso.withColumn("shown", X.display_time(X.from_iso(F.col("iso"))))


@_query("content_ids", "SELECT event_id, substr(sha256(event_type || chr(31) || props), 1, 9) AS id FROM events WHERE props IS NOT NULL")
def content_ids(spark, d):
    return _read(spark, d, "events").filter("props is not null").select("event_id", X.content_id("event_type", "props").alias("id"))


_SCORED = f"""WITH q AS (SELECT item_id, {_WORDS} AS qt FROM benchmark), a AS (SELECT doc_id, {_WORDS} AS dt FROM (SELECT doc_id, concat_ws(' ', source, text) AS text FROM documents) AS x),
s AS (SELECT item_id AS query_id, doc_id AS id, len(list_intersect(qt, dt)) / len(qt) AS confidence FROM q, a WHERE len(qt) > 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, id) AS BIGINT) AS rank FROM s WHERE confidence >= 0.8)"""


@_query("support_retrieval", f"{_SCORED} SELECT query_id, id, confidence, rank FROM r")
def support_retrieval(spark, d):
    return support.retrieve(_asked(spark, d), _library(spark, d))


@_query("support_best_answer", f"{_SCORED} SELECT query_id, id, confidence, d.text AS text, CAST(id AS VARCHAR) AS related_article FROM r JOIN documents AS d ON d.doc_id = r.id WHERE rank = 1")
def support_best_answer(spark, d):
    return support.as_response(support.answers(_asked(spark, d), _library(spark, d)))


@_query("answer_articles", "SELECT CAST(l.doc_id AS VARCHAR) AS related_article, source AS article_title FROM labels AS l LEFT JOIN documents AS d USING (doc_id)")
def answer_articles(spark, d):
    return catalog.with_article(_references(spark, d), articles(spark, d)).select("related_article", "article_title")


_CUR = "(SELECT d.doc_id AS source_id, sha256(CASE WHEN quality = 0 THEN 'old ' || coalesce(text, '') ELSE coalesce(text, chr(0)) END) AS content_hash FROM documents AS d JOIN labels USING (doc_id))"
_SRC = "(SELECT doc_id AS source_id, sha256(coalesce(text, chr(0))) AS content_hash FROM documents)"


@_query("sync_new", f"SELECT source_id, content_hash FROM {_SRC} AS s ANTI JOIN {_CUR} AS c USING (source_id)")
def sync_new(spark, d):
    return sync.new_rows(_source(spark, d), _current(spark, d)).select("source_id", "content_hash")


@_query("sync_modified", f"SELECT source_id, s.content_hash AS content_hash FROM {_SRC} AS s JOIN {_CUR} AS c USING (source_id) WHERE s.content_hash <> c.content_hash")
def sync_modified(spark, d):
    return sync.modified_rows(_source(spark, d), _current(spark, d)).select("source_id", "content_hash")


@_query("sync_upsert", f"SELECT source_id, coalesce(s.content_hash, c.content_hash) AS content_hash, CASE WHEN c.content_hash IS NULL THEN 'inserted' WHEN s.content_hash IS NULL THEN 'kept' WHEN s.content_hash = c.content_hash THEN 'unchanged' ELSE 'updated' END AS outcome FROM {_SRC} AS s FULL JOIN {_CUR} AS c USING (source_id)")
def sync_upsert(spark, d):
    return sync.upsert(_source(spark, d), _current(spark, d)).select("source_id", "content_hash", "outcome")


@_query("sync_outcome", f"SELECT CASE WHEN c.content_hash IS NULL THEN 'inserted' WHEN s.content_hash IS NULL THEN 'kept' WHEN s.content_hash = c.content_hash THEN 'unchanged' ELSE 'updated' END AS outcome, count(*) AS n FROM {_SRC} AS s FULL JOIN {_CUR} AS c USING (source_id) GROUP BY 1")
def sync_outcome(spark, d):
    return sync_upsert(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


@_query("sync_deactivate", "SELECT d.doc_id AS source_id, l.doc_id IS NULL AS active FROM documents AS d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) AS l USING (doc_id)")
def sync_deactivate(spark, d):
    current = _source(spark, d).withColumn("active", F.lit(None).cast("boolean"))
    gone = _read(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("source_id"))
    return sync.deactivate(current, gone).select("source_id", "active")


@_query("active_articles", "SELECT d.doc_id AS source_id FROM documents AS d ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) AS l USING (doc_id)")
def active_articles(spark, d):
    current = _source(spark, d).withColumn("active", F.lit(None).cast("boolean"))
    gone = _read(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("source_id"))
    return catalog.active(sync.deactivate(current, gone)).select("source_id")


@_query("invalid_records", "SELECT event_id, 'unknown event_type' AS reason FROM events WHERE event_type NOT IN ('error', 'click', 'view', 'signup')")
def invalid_records(spark, d):
    known = ("error", "click", "view", "signup")
    reason = F.when(~F.col("event_type").isin(*known), "unknown event_type")
    return split_valid(_read(spark, d, "events").withColumn("reason", reason))[1].select("event_id", "reason")


_LINES = f"(SELECT 'user-' || user_id AS file, event_id AS line_no, ts, {_LVL} AS level, event_type || coalesce(' ' || props, '') AS message FROM events)"
_ISSUES = f"""(SELECT file, line_no, 'failure' AS pattern, 'CRITICAL' AS severity FROM {_LINES} AS l WHERE regexp_matches(message, '^error')
UNION ALL SELECT file, line_no, 'high-k' AS pattern, 'WARNING' AS severity FROM {_LINES} AS l WHERE regexp_matches(message, '"k": 9[0-9]'))"""
_LEVELS = f"SELECT file, line_no, lower(level) AS pattern, CASE level WHEN 'ERROR' THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM {_LINES} AS l WHERE level IN ('ERROR', 'WARN')"
_HOURS = f"SELECT h.file, CAST(NULL AS BIGINT) AS line_no, 'anomaly' AS pattern, 'WARNING' AS severity FROM (SELECT file, level, date_trunc('hour', ts) AS hour, count(*) AS n FROM {_LINES} AS l GROUP BY ALL) AS h JOIN (SELECT file, level, avg(n) AS m, stddev_samp(n) AS s FROM (SELECT file, level, date_trunc('hour', ts) AS hour, count(*) AS n FROM {_LINES} AS l GROUP BY ALL) AS k GROUP BY file, level) AS u USING (file, level) WHERE n > m + 3 * coalesce(s, 0)"
_FINDINGS = f"(SELECT * FROM {_ISSUES} AS i UNION ALL {_LEVELS} UNION ALL {_HOURS})"
_STATUSES = f"(SELECT f.file, CASE max(CASE i.severity WHEN 'CRITICAL' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END) WHEN 2 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' ELSE 'OK' END AS status, count(i.severity) AS issues FROM (SELECT DISTINCT file FROM {_LINES} AS l) AS f LEFT JOIN {_FINDINGS} AS i USING (file) GROUP BY f.file)"


@_query("log_issues", f"SELECT * FROM {_ISSUES} AS i")
def log_issues(spark, d):
    return monitoring.issues(log_lines(spark, d), RULES).select("file", "line_no", "pattern", "severity")


@_query("log_level_issues", _LEVELS)
def log_level_issues(spark, d):
    return monitoring.level_issues(log_lines(spark, d)).select("file", "line_no", "pattern", "severity")


@_query("log_status", f"SELECT file, status, CAST(issues AS BIGINT) AS issues FROM {_STATUSES} AS s")
def log_status(spark, d):
    return monitoring.analyse(log_lines(spark, d), RULES)


@_query("log_line_counts", f"SELECT file, count(*) AS lines, count(*) FILTER (level IS NULL) AS unparsed FROM {_LINES} AS l GROUP BY file")
def log_line_counts(spark, d):
    return monitoring.line_counts(log_lines(spark, d))


@_query("log_recent_events", f"SELECT file, line_no, level FROM {_LINES} AS l ORDER BY ts DESC, line_no DESC LIMIT 20")
def log_recent_events(spark, d):
    return monitoring.recent_events(log_lines(spark, d), 20).select("file", "line_no", "level")


@_query("log_anomaly_hours", "WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL), u AS (SELECT event_type, avg(n) AS m, stddev_samp(n) AS s FROM h GROUP BY event_type) SELECT event_type, strftime(hour, '%Y-%m-%d %H') AS hour, n FROM h JOIN u USING (event_type) WHERE n > m + 3 * coalesce(s, 0)")
def log_anomaly_hours(spark, d):
    return monitoring.anomalies(_read(spark, d, "events"), "event_type").select("event_type", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "n")


@_query("notification_events", f"SELECT substr(sha256(file || chr(31) || status || chr(31) || issues), 1, 9) AS id, 'Log analysis: ' || status AS title, issues || ' issues in ' || file AS message, CASE status WHEN 'CRITICAL' THEN 'error' ELSE 'warning' END AS type, false AS read FROM {_STATUSES} AS s WHERE status <> 'OK'")
def notification_events(spark, d):
    return monitoring.notifications(log_status(spark, d))


@_query("analysis_payload", f"SELECT CAST(row_number() OVER (PARTITION BY file ORDER BY ts, line_no) - 1 AS BIGINT) AS position, level, message FROM {_LINES} AS l")
def analysis_payload(spark, d):
    return monitoring.positions(log_lines(spark, d)).select("position", "level", "message")


@_query("log_findings", f"SELECT * FROM {_FINDINGS} AS f")
def log_findings(spark, d):
    return monitoring.findings(log_lines(spark, d), RULES)


_LAST = f"SELECT * FROM {_LINES} AS l ORDER BY ts DESC, line_no DESC LIMIT 20"


@_query("payload_events", f"SELECT CAST(row_number() OVER (ORDER BY ts, line_no) - 1 AS BIGINT) AS position, line_no, level FROM ({_LAST}) AS x")
def payload_events(spark, d):
    """The last 20 events as the nested list of one payload, and back."""
    last = monitoring.recent_events(log_lines(spark, d), 20)
    payload = last.agg(F.array_sort(F.collect_list(F.struct("ts", "line_no", "level", "message"))).alias("recent_events"))
    return monitoring.unnest_events(payload).select(F.col("position").cast("long").alias("position"), "line_no", "level")


@_query("payload_issues", f"SELECT line_no, pattern, severity FROM {_ISSUES} AS i")
def payload_issues(spark, d):
    """Each line's issues (at most one for each rule) as a nested list, and back."""
    found = monitoring.issues(log_lines(spark, d), RULES)
    nested = found.groupBy("file", "line_no").agg(F.collect_list(F.struct("line_no", "pattern", "severity")).alias("issues"))
    return monitoring.unnest_issues(nested)


@_query("payload_file_info", "SELECT event_type AS file_status, json_extract_string(props, '$.k') AS size, CAST(NULL AS VARCHAR) AS last_modified FROM events")
def payload_file_info(spark, d):
    """The nested fields of the events' JSON; one that a payload doesn't have is null."""
    info = F.from_json("props", "struct<k:string,last_modified:string>")
    return monitoring.file_info(_read(spark, d, "events").select(F.col("event_type").alias("file_status"), F.struct(info["k"].alias("size"), info["last_modified"].alias("last_modified")).alias("file_info")))


KINDS = ("click", "error", "purchase", "signup", "view")


_log_folders: dict[tuple[str, str], str] = {}


def _log_folder(spark, d) -> str:
    """The events as text logs, a folder of files for each event type, in the shared folder; written once for a session and folder of tables."""
    of = (spark.sparkContext.applicationId, d)
    if of not in _log_folders:
        _log_folders[of] = _write_logs(spark, d)
    return _log_folders[of]


def _write_logs(spark, d) -> str:
    folder = f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"
    e = _read(spark, d, "events")
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), _case(F.col("event_type"), LEVEL_OF, "INFO"), F.lit("event"), F.col("event_id").cast("string"))
    value = F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("no log line "), F.col("event_id").cast("string"))).otherwise(line)
    rows = e.select("event_id", F.col("event_type").alias("kind"), value.alias("value")).repartitionByRange("event_id")
    rows.sortWithinPartitions("kind", "event_id").select("kind", "value").write.partitionBy("kind").text(folder)
    return folder


_FILE_LINE = f"SELECT event_type AS kind, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS BIGINT) AS line_no, CASE WHEN event_id % 10 <> 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at, CASE WHEN event_id % 10 <> 3 THEN {_LVL} END AS level, CASE WHEN event_id % 10 = 3 THEN 'no log line ' ELSE 'event ' END || event_id AS message FROM events"


def _read_kinds(spark, d):
    folder = _log_folder(spark, d)
    lines, status = readers.read_logs(spark, [f"{folder}/kind={k}" for k in KINDS] + [f"{folder}/missing.log"])
    kind = F.regexp_replace(F.element_at(F.split("file", "/"), -1), "^kind=", "")
    return lines.withColumn("kind", kind), status.withColumn("kind", kind)


@_query("log_files_read", _FILE_LINE)
def log_files_read(spark, d):
    """Files are read, their lines parsed and numbered; what doesn't parse is kept."""
    return _read_kinds(spark, d)[0].select("kind", "line_no", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "level", "message")


@_query("log_files_access", "SELECT DISTINCT event_type AS kind, 'read' AS file_status FROM events UNION ALL SELECT 'missing.log', 'inaccessible'")
def log_files_access(spark, d):
    return _read_kinds(spark, d)[1].select("kind", "file_status")


@_query("log_files_counts", f"SELECT kind, count(*) AS lines, count(*) FILTER (level IS NULL) AS unparsed FROM ({_FILE_LINE}) AS f GROUP BY kind")
def log_files_counts(spark, d):
    return monitoring.line_counts(_read_kinds(spark, d)[0].withColumn("file", F.col("kind"))).withColumnRenamed("file", "kind")


@_query("entities_read", "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS type FROM events WHERE event_type IN ('view', 'error')")
def entities_read(spark, d):
    """Events as JSON lines read with the schema of an entity; of other types and without an id go to the quarantine."""
    path = f"{shared_folder(spark)}/entities-{uuid.uuid4().hex}"
    _read(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("type")).write.json(path)
    return readers.read_entities(spark, path, T.StructType.fromDDL("id string, type string"), {"type": ("view", "error")})[0]


@_query("entities_quarantined", "SELECT CASE WHEN event_id % 7 = 0 THEN 'no id' ELSE 'unknown type' END AS reason, count(*) AS n FROM events WHERE event_id % 7 = 0 OR event_type NOT IN ('view', 'error') GROUP BY 1")
def entities_quarantined(spark, d):
    path = f"{shared_folder(spark)}/entities-{uuid.uuid4().hex}"
    some = F.when(F.col("event_id") % 7 != 0, F.col("event_id").cast("string"))
    _read(spark, d, "events").select(some.alias("id"), F.col("event_type").alias("type")).write.json(path)
    bad = readers.read_entities(spark, path, T.StructType.fromDDL("id string, type string"), {"type": ("view", "error")})[1]
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


@_query("page_items", "SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS BIGINT) AS items, CASE WHEN doc_id % 3 = 0 THEN lang END AS first FROM documents")
def page_items(spark, d):
    """Responses with two items, without items, and broken ones."""
    item = F.struct(F.col("lang").alias("id"))
    body = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.array(item, item).alias("items")))).when(F.col("doc_id") % 3 == 1, '{"pagination":{}}').otherwise("not json")
    items = readers.page_items(F.col("body"), T.StructType.fromDDL("items array<struct<id:string>>"))
    return _read(spark, d, "documents").select("doc_id", body.alias("body")).select("doc_id", items.alias("items")).select("doc_id", F.size("items").cast("long").alias("items"), F.try_element_at("items", F.lit(1))["id"].alias("first"))


@_query("chosen_slots", "SELECT r_regionkey AS slot, r_name || '.log' AS path FROM region WHERE r_regionkey % 2 = 0")
def chosen_slots(spark, d):
    path = F.when(F.col("r_regionkey") % 2 == 0, F.concat("r_name", F.lit(".log")))
    return readers.chosen_files(_read(spark, d, "region").select(F.col("r_regionkey").alias("slot"), path.alias("path")))


@_query("removed_slot", "SELECT conv_id, text AS path FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS r FROM conversations) AS t WHERE r <> 2")
def removed_slot(spark, d):
    """Each conversation's texts as slots in the order of turns, without the second one."""
    turns = _read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    return turns.select("conv_id", F.explode(readers.without_slot(F.transform("turns", lambda t: t["text"]), 1)).alias("path"))


@_query("export_read_back", f"SELECT CAST(event_id AS VARCHAR) AS id, event_type AS message, {_META} AS metadata FROM events")
def export_read_back(spark, d):
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    feed = activities(spark, d).select("id", "message", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))
    export_log(feed, path, "csv")
    return spark.read.csv(path, header=True, schema="id string, message string, metadata string")


@_query("sync_run", f"SELECT CASE WHEN c.content_hash IS NULL THEN 'inserted' WHEN s.content_hash IS NULL THEN 'kept' WHEN s.content_hash = c.content_hash THEN 'unchanged' ELSE 'updated' END AS outcome, count(*) AS n FROM {_SRC} AS s FULL JOIN {_CUR} AS c USING (source_id) GROUP BY 1")
def sync_run(spark, d):
    """A whole synchronization: the current version is read, the next one written, its outcomes counted."""
    folder = f"{shared_folder(spark)}/sync-{uuid.uuid4().hex}"
    write_version(_current(spark, d).withColumn("outcome", F.lit("")), folder, 0)
    return sync.run_sync(_source(spark, d), folder, 0).withColumnRenamed("count", "n")


@_query("sync_delete", "SELECT doc_id AS source_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def sync_delete(spark, d):
    gone = _read(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("source_id"))
    return sync.delete(_source(spark, d), gone).select("source_id")


_TRACE = f"{_SCORED}, t AS (SELECT substr(sha256('query' || chr(31) || item_id), 1, 9) AS event_id, 'query' AS kind, CAST(item_id AS VARCHAR) AS subject, CAST(r.id AS VARCHAR) AS matched, confidence, CASE WHEN r.id IS NULL THEN 'no answer' ELSE 'answered' END AS outcome FROM benchmark LEFT JOIN r ON r.query_id = item_id AND rank = 1 UNION ALL SELECT substr(sha256('run' || chr(31) || file), 1, 9), 'run', file, NULL, NULL, status FROM {_STATUSES} AS s)"


@_query("trace_log", f"{_TRACE} SELECT * FROM t")
def trace_log(spark, d):
    return trace.of_queries(_asked(spark, d), support_retrieval(spark, d)).unionByName(trace.of_runs(log_status(spark, d)))


@_query("trace_articles", f"{_TRACE} SELECT subject, matched, source AS title FROM t LEFT JOIN documents AS d ON CAST(d.doc_id AS VARCHAR) = matched WHERE kind = 'query'")
def trace_articles(spark, d):
    records = trace.of_queries(_asked(spark, d), support_retrieval(spark, d))
    return trace.with_articles(records, _library(spark, d)).select("subject", "matched", "title")


@_query("debounce_last", "SELECT event_id, user_id FROM (SELECT event_id, user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) AS x WHERE nxt IS NULL OR epoch_us(nxt) - epoch_us(ts) >= 500000")
def debounce_last(spark, d):
    return live.debounce(_read(spark, d, "events"), ["user_id"]).select("event_id", "user_id")


@_query("latest_wins", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) AS x WHERE r = 1")
def latest_wins(spark, d):
    return live.latest(_read(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@_query("stream_snapshot", "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n FROM events GROUP BY ALL")
def stream_snapshot(spark, d):
    """The last snapshot of a stream over the events; each one is a version of its own in the shared folder."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # A pattern, since a stream over a plain path needs a folder and the table may be one file.
    stream = live.stream_of(spark, f"{d}/events.parquet*", _read(spark, d, "events").schema)
    versions: list[int] = []

    def replace(df, batch):
        df.write.mode("overwrite").parquet(f"{folder}/v{batch}")
        versions.append(batch)

    live.refresh(live.snapshot_counts(stream), replace, f"{folder}/state", once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/v{versions[-1]}").select("event_type", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "n")


# Extensions: relational operations that the product's inventory lists as absent.


@_query("ext_event_cube", "SELECT event_type, date_part('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total, grouping(event_type, date_part('hour', ts)) AS level FROM events GROUP BY CUBE (event_type, date_part('hour', ts))")
def ext_event_cube(spark, d):
    e = _read(spark, d, "events").withColumn("hour", F.hour("ts").cast("long"))
    return e.cube("event_type", "hour").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.grouping_id().alias("level"))


@_query("ext_user_windows", "SELECT event_id, CAST(row_number() OVER w AS BIGINT) AS nth, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap_us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def ext_user_windows(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return _read(spark, d, "events").select("event_id", F.row_number().over(w).cast("long").alias("nth"), (us - F.lag(us).over(w)).alias("gap_us"))


@_query("ext_event_pivot", "SELECT user_id, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS view, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def ext_event_pivot(spark, d):
    e = _read(spark, d, "events")
    wide = e.groupBy("user_id").pivot("event_type", ["error", "view"]).count().na.fill(0)
    return wide.join(e.groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds")), "user_id")


@_query("ext_set_operations", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels UNION (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE toxic = 1)")
def ext_set_operations(spark, d):
    docs, labels = _read(spark, d, "documents").select("doc_id"), _read(spark, d, "labels")
    return docs.subtract(labels.select("doc_id")).union(docs.intersect(labels.filter("toxic = 1").select("doc_id"))).distinct()
