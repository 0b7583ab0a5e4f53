"""Article catalog: search, pages, look-up, list and detail rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.scalars import is_blank, or_else

PAGE_SIZE = 100


def matching(articles: DataFrame, search: str | None = None) -> DataFrame:
    """Articles with the text, taken literally and without regard to case, in id, title or category.
    A blank text matches all."""
    if not search or not search.strip():
        return articles
    found = F.lit(False)
    for c in ("id", "title", "category"):
        found = found | F.coalesce(F.contains(F.lower(F.col(c)), F.lower(F.lit(search))), F.lit(False))
    return articles.filter(found)


def page(rows: DataFrame, number: int, size: int = PAGE_SIZE, order: str = "id") -> DataFrame:
    """Page `number`, from 1, in the order of a unique key: a top-k, not a full sort."""
    if size < 1:
        raise ValueError("a page has at least one row")
    return rows.orderBy(order).offset((max(number, 1) - 1) * size).limit(size)


def pagination(rows: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """One row about page `number`; past the end there is no next page, and previous is null at the first."""
    if size < 1:
        raise ValueError("a page has at least one row")
    number = max(number, 1)
    total = rows.agg(F.count("*").alias("total_items"))
    pages = F.ceil(F.col("total_items") / size).cast("long")
    return total.select(
        F.lit(number).cast("long").alias("current_page"),
        F.lit(size).cast("long").alias("page_size"),
        "total_items",
        pages.alias("total_pages"),
        (F.lit(number) < pages).alias("has_next_page"),
        F.lit(number > 1).alias("has_previous_page"),
        F.when(F.lit(number) < pages, F.lit(number + 1).cast("long")).alias("next_page"),
        F.when(F.lit(number > 1), F.lit(number - 1).cast("long")).alias("previous_page"),
    )


def lookup(articles: DataFrame, article_id, key: str = "id") -> DataFrame:
    """The article with this id. On a stored key the predicate reaches the scan; compare before an id is cast to text."""
    return articles.filter(F.col(key) == article_id).limit(1)


def list_rows(articles: DataFrame) -> DataFrame:
    return articles.select("id", "title", "category", "views")


def steps(articles: DataFrame) -> DataFrame:
    """Resolution steps with their positions from 1."""
    return articles.select("id", F.posexplode("resolution_steps").alias("pos", "step")).select("id", (F.col("pos") + 1).cast("long").alias("position"), "step")


def detail_rows(articles: DataFrame) -> DataFrame:
    return articles.select("id", "title", "category", "last_updated", "description", "resolution_steps")


def active(articles: DataFrame) -> DataFrame:
    """Without articles that were deactivated; null counts as active."""
    return articles.filter(F.coalesce("active", F.lit(True)))


def link_target(rows: DataFrame) -> DataFrame:
    """Where a reference leads: its own URL, else the article's page; null if it names neither."""
    return rows.withColumn("link", or_else(F.col("related_article_url"), F.concat(F.lit("/article/"), F.col("related_article"))))


def with_article(rows: DataFrame, articles: DataFrame) -> DataFrame:
    """Resolve references to articles; rows without one stay. Spark picks the join by the sizes."""
    named = articles.select(F.col("id").alias("related_article"), F.col("title").alias("article_title"))
    return rows.join(named, "related_article", "left")


def asked(queries: DataFrame) -> DataFrame:
    """Queries that aren't blank; their text stays as it was typed."""
    return queries.filter(~is_blank(F.col("query")))
