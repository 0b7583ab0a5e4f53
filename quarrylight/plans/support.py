"""Retrieval of support articles with a confidence, and extractive answers.

The confidence of an article for a query is the share of the query's distinct words that it has. Articles under the
threshold are no answer. A query with n words needs m = ceil(threshold n) of them, so an article that reaches the
threshold has at least one of the n - m + 1 words of the query that are rarest in the articles. Only those words
are joined, which leaves out the frequent ones; the articles found are then scored on all words, so the result is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions.scalars import terms
from quarrylight.sources.writers import computed_once

THRESHOLD = 0.8


def article_terms(articles: DataFrame) -> DataFrame:
    """id and the distinct words of title, keywords and text (those of them that are there)."""
    parts = [F.array_join(c, " ") if t.startswith("array") else F.col(c).cast("string") for c, t in articles.dtypes if c in ("title", "keywords", "text")]
    return articles.select("id", terms(F.concat_ws(" ", *parts)).alias("article_terms"))


def retrieve(queries: DataFrame, articles: DataFrame, threshold: float = THRESHOLD, k: int | None = None) -> DataFrame:
    """query_id, article id, confidence and rank of all articles at or above the threshold (the k best of each query).

    queries: query_id, query. articles: id (any ordered type), text, and title and keywords if there are any.
    The articles are cut into words once; only words that some query has are kept and shuffled.
    """
    asked = queries.select("query_id", terms(F.col("query")).alias("query_terms")).filter(F.size("query_terms") > 0)
    asked_terms = asked.select("query_id", F.size("query_terms").alias("n"), F.explode("query_terms").alias("term"))
    words = article_terms(articles).select("id", F.explode("article_terms").alias("term"))
    posted = computed_once(words.join(asked_terms.select("term").distinct(), "term", "left_semi"))
    frequency = posted.groupBy("term").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("query_id").orderBy("df", "term")
    needed = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1
    rare = asked_terms.join(frequency, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("r", F.row_number().over(rarest)).filter(F.col("r") <= needed)
    candidates = posted.join(rare.select("query_id", "term"), "term").select("query_id", "id").distinct()
    scored = candidates.join(asked_terms, "query_id").join(posted, ["id", "term"]).groupBy("query_id", "id").agg((F.count("*") / F.first("n")).alias("confidence"))
    ranked = scored.filter(F.col("confidence") >= threshold - 1e-12).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("confidence"), "id")).cast("long"))
    return ranked.filter(F.col("rank") <= k) if k else ranked


def answers(queries: DataFrame, articles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The best article's own words as the answer: its text, confidence, and ordered steps. No answer, no row."""
    best = retrieve(queries, articles, threshold, k=1)
    own = articles.select("id", F.col("text").alias("answer"), *(["resolution_steps"] if "resolution_steps" in articles.columns else []))
    return best.join(own, "id").withColumn("related_article", F.col("id").cast("string")).drop("rank")


def as_response(answer: DataFrame) -> DataFrame:
    """The response's names: answer becomes text."""
    return answer.withColumnRenamed("answer", "text")
