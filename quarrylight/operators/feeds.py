"""Activity, notification and statistics feeds, and the changes made to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions.maps import activity_class
from quarrylight.functions.scalars import content_id, display_time, json_or_empty

def newest(feed: DataFrame, n: int) -> DataFrame:
    """The n newest rows with their position from 1; equal times go by id, larger first."""
    top = feed.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)
    return top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("timestamp"), F.desc("id"))).cast("long"))  # over n rows


def activity_rows(feed: DataFrame) -> DataFrame:
    return feed.select("id", display_time(F.col("timestamp")).alias("shown_at"), "message", "user", F.upper("type").alias("type"), activity_class(F.col("type")).alias("class"), json_or_empty(F.col("metadata")).alias("details"))


def notification_rows(feed: DataFrame) -> DataFrame:
    return feed.select("id", "title", "message", display_time(F.col("timestamp")).alias("shown_at"), "type", "read")


def unread(feed: DataFrame) -> DataFrame:
    return feed.filter(~F.coalesce("read", F.lit(False)))


def unread_count(feed: DataFrame) -> DataFrame:
    n = F.count_if(~F.coalesce("read", F.lit(False)))
    return feed.agg(n.cast("long").alias("unread"), (n > 0).alias("has_unread"))


def search_feed(feed: DataFrame, text: str) -> DataFrame:
    """Activities with the text in message, user or details, without regard to case."""
    found = F.lit(False)
    for c in (F.col("message"), F.col("user"), json_or_empty(F.col("metadata"))):
        found = found | F.coalesce(F.contains(F.lower(c), F.lower(F.lit(text))), F.lit(False))
    return feed.filter(found)


def of_types(feed: DataFrame, *types: str) -> DataFrame:
    return feed.filter(F.col("type").isin(*types)) if types else feed


def insert(feed: DataFrame, rows: DataFrame, read: bool | None = None) -> DataFrame:
    """Add rows with ids made from their contents; a notification comes in unread."""
    own = rows.withColumn("id", content_id(*[F.col(c).cast("string") for c in rows.columns if c != "id" and not dict(rows.dtypes)[c].startswith("map")]))
    if read is not None:
        own = own.withColumn("read", F.lit(read))
    return feed.unionByName(own.select(*feed.columns))


def mark_read(feed: DataFrame, which: Column | None = None) -> DataFrame:
    """Set read where `which` holds (everywhere without it); other rows stay as they are."""
    return feed.withColumn("read", F.lit(True) if which is None else F.when(which, True).otherwise(F.col("read")))


def cleared(feed: DataFrame) -> DataFrame:
    return feed.filter(F.lit(False))


def stats(queries: DataFrame, logs: DataFrame, is_issue: Column, articles: DataFrame) -> DataFrame:
    """One row of four counts; log rows for which is_issue holds are issues. Each frame gives one row, so joining them is
    no product of tables."""
    counted = logs.agg(F.count("*").alias("activeLogs"), F.count_if(is_issue).alias("detectedIssues"))
    return queries.agg(F.count("*").alias("supportQueries")).crossJoin(counted).crossJoin(articles.agg(F.count("*").alias("kbArticles")))


def merge_stats(base: DataFrame, update: DataFrame) -> DataFrame:
    """The update's values where it has them; both are one row."""
    given = update.select(*(F.col(c).alias(f"new_{c}") for c in update.columns))
    return base.crossJoin(given).select(*(F.coalesce(f"new_{c}", c).alias(c) if c in update.columns else F.col(c) for c in base.columns))


#: The labels of the four statistics.
CARDS = {"supportQueries": "Support Queries", "activeLogs": "Active Logs", "detectedIssues": "Detected Issues", "kbArticles": "KB Articles"}


def stats_cards(row: DataFrame) -> DataFrame:
    """The statistics as labelled rows with their values as text."""
    long = row.unpivot([], list(CARDS), "name", "n")
    label = F.element_at(F.create_map(*(F.lit(x) for kv in CARDS.items() for x in kv)), F.col("name"))
    value = F.col("n").cast("string")
    return long.select(label.alias("label"), F.when(F.col("name") == "activeLogs", F.concat(value, F.lit(" Logs"))).otherwise(value).alias("value"))


def counters(runs: DataFrame) -> DataFrame:
    """Counters derived from the log of analysis runs (files, issues), so no update can be lost."""
    return runs.agg(F.coalesce(F.sum("files"), F.lit(0)).cast("long").alias("activeLogs"), F.coalesce(F.sum("issues"), F.lit(0)).cast("long").alias("detectedIssues"), F.count("*").alias("runs"))
