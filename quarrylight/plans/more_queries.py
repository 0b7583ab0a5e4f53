"""Queries over streams, ranges of time, many rules and laid-out tables, each with its DuckDB twin."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from quarrylight.operators import measures, sync, temporal
from quarrylight.plans import monitoring, rules
from quarrylight.plans.queries import _CUR, _FILE_LINE, _SRC, ORACLES, _current, _query, _read, _read_kinds, _source, activities, notifications
from quarrylight.sources import tables
from quarrylight.sources.writers import computed_once, shared_folder
from quarrylight.streaming import feeds as live
from quarrylight.streaming import stateful

GAP, DELAY = "12 hours", "1 hour"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _sliced(spark: SparkSession, d: str, slices: int) -> DataFrame:
    """The events with `slice`: which of as many equal stretches of the table's time they belong to."""
    e = _read(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    low, high = e.agg(F.min("us"), F.max("us")).first()
    return e.withColumn("slice", F.expr(f"((us - {low or 0}) * {slices}) div {(high or 0) - (low or 0) + 1}")).drop("us")


#: The moment after all events at which streams are told that nothing else comes.
_END = "timestamp_ntz'2100-01-01 00:00:00'"


def _closing(rows: DataFrame) -> DataFrame:
    """A row of user -1 far behind all others, which moves the watermark past them."""
    made = [F.expr(_END).alias(c) if c == "ts" else F.lit(-1).cast(t).alias(c) if t == "bigint" else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]
    return rows.sparkSession.range(1).select(*made)


_SESSIONS = """SELECT user_id, min(us) AS first_us, max(us) AS last_us, count(*) AS events FROM (
  SELECT user_id, us, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id) AS s FROM (
    SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 43200000000 THEN 0 ELSE 1 END AS fresh FROM events
  ) AS a) AS b GROUP BY user_id, s"""


def _in_us(sessions: DataFrame) -> DataFrame:
    return sessions.select("user_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "events")


@_query("user_sessions", _SESSIONS)
def user_sessions(spark, d):
    return _in_us(stateful.sessions(_read(spark, d, "events"), ["user_id"], GAP))


@_query("stream_sessions", _SESSIONS)
def stream_sessions(spark, d):
    """The same from a stream, whose sessions grow and merge over the deliveries."""
    e = _sliced(spark, d, 2).select("event_id", "user_id", "ts", "slice")
    slices = [e.filter(F.col("slice") == k).drop("slice") for k in range(2)]
    out = stateful.replay([*slices, _closing(slices[0])], _folder(spark, "sessions"), lambda source: stateful.sessions(source("rows"), ["user_id"], GAP, delay=DELAY))
    return _in_us(out)


@_query("sliding_counts", "SELECT event_type, strftime(w, '%Y-%m-%d %H') AS window_start, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 4 HOUR, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 2 HOUR, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01')]) AS w FROM events) AS x GROUP BY ALL")
def sliding_counts(spark, d):
    return stateful.sliding_counts(_read(spark, d, "events"), ["event_type"], "6 hours", "2 hours").select("event_type", F.date_format("window_start", "yyyy-MM-dd HH").alias("window_start"), "n")


@_query(
    "stream_late_counts",
    """WITH b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
a AS (SELECT event_type, epoch_us(ts) AS us, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, (epoch_us(ts) - lo) * 2 // (hi - lo + 1) + CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END AS slice FROM events, b),
m AS (SELECT slice, max(top) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, max(top) OVER () AS last FROM (SELECT slice, max(us) AS top FROM a GROUP BY slice) AS t),
j AS (SELECT event_type, day, coalesce(epoch_us(day) + 86400000000 <= seen // 1000 * 1000 - 43200000000, false) AS late FROM a JOIN m USING (slice) WHERE epoch_us(day) + 86400000000 <= last // 1000 * 1000 - 43200000000)
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, count(*) FILTER (NOT late) AS on_time, count(*) FILTER (late) AS late FROM j GROUP BY ALL""",
)
def stream_late_counts(spark, d):
    """Daily counts that come out once, half a day behind the newest event; every tenth event is delivered a slice later."""
    e = _sliced(spark, d, 2).withColumn("slice", F.col("slice") + F.when(F.col("event_id") % 10 == 3, 1).otherwise(0))
    rows = e.select("event_type", "ts", "slice")
    folder, seen = _folder(spark, "late"), []
    slices = [rows.filter(F.col("slice") == k).drop("slice") for k in range(3)]
    done = stateful.replay(slices, folder, lambda source: stateful.finalized_counts(source("rows"), ["event_type"], "1 day", "12 hours"), seen.extend)
    until = F.lit(max(p["eventTime"]["watermark"] for p in seen if "watermark" in p["eventTime"])).cast("timestamp")
    told = stateful.late_counts(spark.read.schema(slices[0].schema).parquet(f"{folder}/rows"), done, ["event_type"], "1 day", until)
    return told.select("event_type", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "on_time", "late")


@_query("stream_errors_after_views", "SELECT user_id, e.event_id AS error_id, v.event_id AS view_id FROM events AS e JOIN events AS v USING (user_id) WHERE e.event_type = 'error' AND v.event_type = 'view' AND v.ts <= e.ts AND v.ts >= e.ts - INTERVAL 6 HOUR")
def stream_errors_after_views(spark, d):
    """Two streams joined in an interval. Every seventh event is delivered twice at once, every other seventh again later."""
    return stateful.replay(error_view_slices(spark, d), _folder(spark, "join"), errors_after_views)


def error_view_slices(spark, d) -> list[dict[str, DataFrame]]:
    e = _sliced(spark, d, 2).select("event_id", "user_id", "event_type", "ts", "slice")
    again = e.filter("event_id % 7 in (0, 1)").withColumn("slice", F.col("slice") + F.col("event_id") % 7)
    told = e.unionByName(again)

    def of(kind, name, k):
        return told.filter((F.col("event_type") == kind) & (F.col("slice") == k)).select("user_id", F.col("event_id").alias(f"{name}_id"), F.col("ts").alias(f"{name}_ts"))

    return [{"errors": of("error", "error", k), "views": of("view", "view", k)} for k in range(3)]


def errors_after_views(source) -> DataFrame:
    errors = stateful.once(source("errors"), ["error_id"], DELAY, "error_ts")
    views = stateful.once(source("views"), ["view_id"], DELAY, "view_ts")
    return stateful.interval_join(errors, views, ["user_id"], "6 HOURS", "error_ts", "view_ts").select("user_id", "error_id", "view_id")


@_query("stream_debounce", ORACLES["debounce_last"])
def stream_debounce(spark, d):
    """The debounce as a stream with a state and a timer for each user."""
    e = _sliced(spark, d, 2).select("event_id", "user_id", "ts", "slice")
    slices = [e.filter(F.col("slice") == k).drop("slice") for k in range(2)]
    with stateful.rocksdb(spark):
        out = stateful.replay([*slices, _closing(slices[0])], _folder(spark, "debounce"), lambda source: stateful.debounced(source("rows"), "1 minute"))
    return out.filter("user_id >= 0").select("event_id", "user_id")


@_query("error_last_view", "SELECT e.event_id AS error_id, e.user_id AS user_id, v.event_id AS view_id, epoch_us(e.ts) - epoch_us(v.ts) AS age_us FROM (SELECT * FROM events WHERE event_type = 'error') AS e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts) AS v ON e.user_id = v.user_id AND e.ts >= v.ts")
def error_last_view(spark, d):
    e = _read(spark, d, "events")
    errors = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("ts").alias("error_ts"))
    views = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"))
    out = temporal.asof_join(errors, views, ["user_id"], "error_ts", "view_ts", "view_id", bucket_us=24 * temporal.BUCKET_US)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return out.select("error_id", "user_id", "view_id", (us("error_ts") - us("view_ts")).alias("age_us"))


@_query("system_refresh", "SELECT 'activity' AS source, true AS fresh, count(*) AS n FROM events UNION ALL SELECT 'notifications', true, count(*) FROM events WHERE event_type = 'error' UNION ALL SELECT 'stats', false, 1")
def system_refresh(spark, d):
    """A round of polling over three sources, of which the statistics can't be read and fall back to zeros."""
    folder = _folder(spark, "refresh")
    sources = {
        "activity": lambda: activities(spark, d),
        "notifications": lambda: notifications(spark, d),
        "stats": lambda: spark.read.parquet(f"{folder}/no-such-source"),
    }
    nothing = {"activity": activities(spark, d).limit(0), "notifications": notifications(spark, d).limit(0), "stats": spark.createDataFrame([(0, 0, 0, 0)], "supportQueries long, activeLogs long, detectedIssues long, kbArticles long")}
    told = live.refresh_sources(sources, nothing, lambda name, rows: rows.write.mode("overwrite").parquet(f"{folder}/{name}"))
    counts = [spark.read.parquet(f"{folder}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n") for name in sources]
    return told.join(counts[0].unionAll(counts[1]).unionAll(counts[2]), "source").select("source", "fresh", "n")


_LASTS = "CAST(json_extract_string(props, '$.k') AS BIGINT) * 60000000"


@_query("events_during_errors", f"SELECT r.event_id AS error_id, p.event_id AS event_id FROM events AS r JOIN events AS p ON p.user_id = r.user_id AND epoch_us(p.ts) >= epoch_us(r.ts) AND epoch_us(p.ts) < epoch_us(r.ts) + {_LASTS.replace('props', 'r.props')} WHERE r.event_type = 'error'")
def events_during_errors(spark, d):
    """Each error lasts as many minutes as its k; the events of its user meanwhile, itself included."""
    e = _read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("long")
    ranges = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("ts").alias("start"), F.timestamp_micros(F.unix_micros("ts") + k * 60_000_000).alias("end"))
    return temporal.range_join(e.select("user_id", "event_id", "ts"), ranges, "ts", "start", "end", ["user_id"]).select("error_id", "event_id")


@_query("events_during_anomalies", "WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1), r AS (SELECT hour AS a, hour + to_hours(n) AS b FROM h) SELECT strftime(a, '%Y-%m-%d %H') AS hour, count(*) AS n, min(event_id) AS first_id FROM r JOIN events ON ts >= a AND ts < b GROUP BY a")
def events_during_anomalies(spark, d):
    """Each hour is watched for as many hours as it had events: ranges of all lengths, without a key.

    Ranges begin and end on the hour, so whole hours are joined with them, added up before. An hour's range holds no more hours than the hour had events:
    all together meet no more pairs than there are events."""
    e = _read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    hours = computed_once(e.groupBy(F.date_trunc("hour", "ts").alias("at")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")))  # both sides of the join
    ranges = hours.select(F.col("at").alias("a"), F.timestamp_micros(F.unix_micros("at") + F.col("n") * 3_600_000_000).alias("b"))
    pairs = temporal.range_join(hours, ranges, "at", "a", "b")
    return pairs.groupBy("a").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id")).select(F.date_format("a", "yyyy-MM-dd HH").alias("hour"), "n", "first_id")


def phrase_rules(texts: DataFrame) -> DataFrame:
    """A rule for each three words in a row of some texts (a column `text`), found with any spaces between them."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    at = F.when(F.size("w") >= 3, F.sequence(F.lit(1), F.size("w") - 2)).otherwise(F.array().cast("array<int>"))
    phrases = texts.select(words.alias("w")).select(F.explode(F.transform(at, lambda i: F.array_join(F.slice("w", i, F.lit(3)), " "))).alias("pattern")).distinct()
    safe = F.regexp_replace("pattern", r"([.^$*+?()\[\]{}|\\])", r"\\$1")
    regex = F.concat(F.lit(r"(?:^|\s)"), F.replace(safe, F.lit(" "), F.lit(r"\s+")), F.lit(r"(?:\s|$)"))
    none = F.lit(None).cast("string")
    return phrases.select("pattern", regex.alias("regex"), F.lit("WARNING").alias("severity"), none.alias("description"), none.alias("recommended_action"), none.alias("related_article"))


def text_lines(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split("text", "\n")).alias("line_no", "message")).select("file", F.col("line_no").cast("long").alias("line_no"), F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("level"), "message")


_TOKENS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x : x <> '')"


@_query(
    "phrase_rule_issues",
    rf"""WITH p AS (SELECT DISTINCT array_to_string(ws[i : i + 2], ' ') AS pattern FROM (SELECT ws, unnest(range(1, len(ws) - 1)) AS i FROM (SELECT {_TOKENS} AS ws FROM benchmark) AS a WHERE len(ws) >= 3) AS b),
l AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents),
t AS (SELECT DISTINCT doc_id, line_no, array_to_string(ws[i : i + 2], ' ') AS pattern FROM (SELECT doc_id, line_no, ws, unnest(range(1, len(ws) - 1)) AS i FROM (SELECT doc_id, line_no, {_TOKENS} AS ws FROM l) AS c WHERE len(ws) >= 3) AS e)
SELECT CAST(doc_id AS VARCHAR) AS file, line_no, pattern FROM t JOIN p USING (pattern)""",
)
def phrase_rule_issues(spark, d):
    """The lines of all documents against a rule for each phrase of the benchmark: thousands of expressions."""
    return rules.rule_issues(text_lines(_read(spark, d, "documents")), phrase_rules(_read(spark, d, "benchmark"))).select("file", "line_no", "pattern")


_RUN_RULES = [("unparsed", "^no log line", "WARNING", None, None, None), ("round", "^event [0-9]*00$", "CRITICAL", None, None, None)]


@_query(
    "log_run",
    f"""WITH f AS ({_FILE_LINE}),
h AS (SELECT kind, level, date_trunc('hour', CAST("at" AS TIMESTAMP)) AS hour, count(*) AS n, sum(CAST(regexp_matches(message, '^no log line') AS INT) + CAST(regexp_matches(message, '^event [0-9]*00$') AS INT) + CAST(coalesce(level IN ('ERROR', 'WARN'), false) AS INT)) AS issues,
  max(CASE WHEN regexp_matches(message, '^event [0-9]*00$') OR level = 'ERROR' THEN 2 WHEN regexp_matches(message, '^no log line') OR level = 'WARN' THEN 1 ELSE 0 END) AS worst FROM f GROUP BY ALL),
u AS (SELECT kind, level, avg(n) AS m, stddev_samp(n) AS s FROM h GROUP BY ALL),
a AS (SELECT h.*, CASE WHEN h.level IS NOT NULL AND n > m + 3 * coalesce(s, 0) THEN 1 ELSE 0 END AS odd FROM h JOIN u ON u.kind = h.kind AND u.level IS NOT DISTINCT FROM h.level),
r AS (SELECT kind, 'read' AS file_status, CASE greatest(max(worst), max(odd)) WHEN 2 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' ELSE 'OK' END AS status, CAST(sum(issues) + sum(odd) AS BIGINT) AS issues FROM a GROUP BY kind UNION ALL SELECT 'missing.log', 'inaccessible', 'FAILED', NULL)
SELECT *, CASE WHEN status IN ('WARNING', 'CRITICAL') THEN 'Log analysis: ' || status WHEN status = 'FAILED' THEN 'Log analysis failed: ' || file_status END AS title, CASE WHEN status = 'WARNING' THEN 'warning' WHEN status <> 'OK' THEN 'error' END AS type FROM r""",
)
def log_run(spark, d):
    """A whole monitoring run over log files: read, one that can't be read, analysed, told, traced."""
    lines, access = _read_kinds(spark, d)
    told = monitoring.run(lines, access.drop("kind"), _RUN_RULES)
    return told.withColumn("kind", F.regexp_replace(F.element_at(F.split("file", "/"), -1), "^kind=", "")).select("kind", "file_status", "status", "issues", "title", "type")


@_query("distinct_users_by_day", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS users, true AS within FROM events GROUP BY 1")
def distinct_users_by_day(spark, d):
    """Hourly sketches are stored and merged to days; the rows say whether the estimate lies within the stated error."""
    e = _read(spark, d, "events")
    path = _folder(spark, "sketches")
    measures.distinct_sketches(e, [F.date_trunc("hour", "ts").alias("hour")], "user_id").write.parquet(path)
    day = F.date_format("hour", "yyyy-MM-dd").alias("day")
    estimates = measures.merged_estimates(spark.read.parquet(path), [day])
    exact = e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_distinct("user_id").alias("users"))
    return exact.join(estimates, "day").select("day", "users", (F.abs(F.col("estimate") - F.col("users")) <= F.col("users") * measures.estimate_error()).alias("within"))


@_query("value_percentiles", " UNION ALL ".join(f"SELECT event_type, CAST({q} AS DOUBLE) AS fraction, quantile_disc(value, {q}) AS value FROM events GROUP BY event_type" for q in (0.5, 0.9, 0.99)))
def value_percentiles(spark, d):
    return measures.exact_percentiles(_read(spark, d, "events"), ["event_type"], "value", [0.5, 0.9, 0.99])


@_query("sync_partial", f"SELECT CASE WHEN c.content_hash IS NULL THEN 'inserted' WHEN s.content_hash IS NULL THEN 'kept' WHEN s.content_hash = c.content_hash THEN 'unchanged' ELSE 'updated' END AS outcome, count(*) AS n FROM {_SRC} AS s FULL JOIN {_CUR} AS c USING (source_id) GROUP BY 1")
def sync_partial(spark, d):
    """A synchronization that writes only the buckets in which something changed."""
    folder = _folder(spark, "buckets")
    sync.write_buckets(_current(spark, d), folder, 0)
    return sync.sync_buckets(_source(spark, d), folder, 0)


@_query("order_totals", "SELECT o_orderkey, o_orderpriority, count(l_orderkey) AS lines, coalesce(sum(l_quantity), 0) AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def order_totals(spark, d):
    """Orders and their lines from tables in buckets of the order: joined and added up without a shuffle."""
    mark = uuid.uuid4().hex
    o = tables.bucketed(_read(spark, d, "orders").select("o_orderkey", "o_orderpriority"), f"orders_{mark}", "o_orderkey", 16)
    i = tables.bucketed(_read(spark, d, "lineitem").select("l_orderkey", "l_quantity"), f"lines_{mark}", "l_orderkey", 16)
    return bucketed_totals(o, i)


def bucketed_totals(orders: DataFrame, lines: DataFrame) -> DataFrame:
    each = lines.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    joined = orders.hint("merge").join(each, orders["o_orderkey"] == each["l_orderkey"], "left")
    return joined.select("o_orderkey", "o_orderpriority", F.coalesce("lines", F.lit(0)).cast("long").alias("lines"), F.coalesce("quantity", F.lit(0.0)).alias("quantity"))


@_query("events_of_region", "SELECT event_id, event_type, r_name AS name FROM events JOIN region ON r_regionkey = CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END WHERE r_name LIKE 'A%'")
def events_of_region(spark, d):
    """Events in folders by a code, joined with the regions of some names: only the folders of these regions are read."""
    code = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "signup", 3).otherwise(4)
    laid = tables.partitioned(_read(spark, d, "events").select("event_id", "event_type", code.alias("code")), _folder(spark, "by-code"), "code")
    return pruned_events(laid, _read(spark, d, "region"))


def pruned_events(laid: DataFrame, region: DataFrame) -> DataFrame:
    some = region.filter("r_name like 'A%'").select(F.col("r_regionkey").alias("code"), F.col("r_name").alias("name"))
    # The regions of the world are few, whatever the scale.
    return laid.join(F.broadcast(some), "code").select("event_id", "event_type", "name")


@pandas_udf(T.DoubleType())
def weighted_median(value: pd.Series, weight: pd.Series) -> float:
    """The smallest value at which half of the weight is reached; for few groups of bounded size, as each is a call of some 2 ms.
    `measures.weighted_medians` has no such bounds."""
    v, w = value.to_numpy(dtype=float), weight.to_numpy(dtype=float)
    known = ~(np.isnan(v) | np.isnan(w))
    v, w = v[known], w[known]
    if not len(v):
        return None
    order = np.argsort(v, kind="stable")
    reached = np.cumsum(w[order])
    return float(v[order][np.searchsorted(reached, reached[-1] / 2)])


@_query("part_weighted_median", "SELECT l_partkey, min(l_extendedprice) AS median_price FROM (SELECT l_partkey, l_extendedprice, sum(l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_extendedprice) AS upto, sum(l_quantity) OVER (PARTITION BY l_partkey) AS total FROM lineitem) AS x WHERE upto >= total / 2 GROUP BY l_partkey")
def part_weighted_median(spark, d):
    """The price of a part's lines weighted by quantity; a part has some thirty lines at any scale, but parts grow with the table."""
    return measures.weighted_medians(_read(spark, d, "lineitem"), ["l_partkey"], "l_extendedprice", "l_quantity").withColumnRenamed("l_extendedprice", "median_price")
