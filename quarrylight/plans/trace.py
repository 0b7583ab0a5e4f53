"""Trace records of queries and of monitoring runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.scalars import content_id

COLUMNS = ("event_id", "kind", "subject", "matched", "confidence", "outcome")


def of_queries(queries: DataFrame, found: DataFrame) -> DataFrame:
    """A record for each query: its best article and confidence, or that there was no answer."""
    best = found.filter("rank = 1").select("query_id", F.col("id").cast("string").alias("matched"), "confidence")
    rows = queries.select("query_id").join(best, "query_id", "left")
    return rows.select(
        content_id(F.lit("query"), F.col("query_id").cast("string")).alias("event_id"), F.lit("query").alias("kind"), F.col("query_id").cast("string").alias("subject"),
        "matched", "confidence", F.when(F.col("matched").isNull(), "no answer").otherwise("answered").alias("outcome"),
    )


def of_runs(statuses: DataFrame) -> DataFrame:
    return statuses.select(
        content_id(F.lit("run"), F.col("file")).alias("event_id"), F.lit("run").alias("kind"), F.col("file").alias("subject"),
        F.lit(None).cast("string").alias("matched"), F.lit(None).cast("double").alias("confidence"), F.col("status").alias("outcome"),
    )


def with_articles(trace: DataFrame, articles: DataFrame) -> DataFrame:
    """Trace records with the title of the article that they matched."""
    return trace.join(articles.select(F.col("id").cast("string").alias("matched"), "title"), "matched", "left")
