"""Explicit schemas of the support-portal entities; readers never infer types."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


ARTICLE = _struct(
    id=_S, title=_S, category=_S, description=_S, keywords=T.ArrayType(_S), last_updated=_S, views=_L,
    resolution_steps=T.ArrayType(_S), source_id=_S, content_hash=_S, active=T.BooleanType(),
)
ACTIVITY = _struct(id=_S, type=_S, message=_S, timestamp=_TS, user=_S, metadata=T.MapType(_S, _S))
NOTIFICATION = _struct(id=_S, title=_S, message=_S, timestamp=_TS, read=T.BooleanType(), type=_S)
STATS = _struct(supportQueries=_L, activeLogs=_L, detectedIssues=_L, kbArticles=_L)
PAGINATION = _struct(
    current_page=_L, page_size=_L, total_items=_L, total_pages=_L,
    has_next_page=T.BooleanType(), has_previous_page=T.BooleanType(), next_page=_L, previous_page=_L,
)
ANSWER = _struct(answer=_S, related_article=_S, related_article_url=_S)
ISSUE = _struct(id=_S, severity=_S, pattern=_S, timestamp=_S, description=_S, recommended_action=_S, related_article=_S, related_article_url=_S)
LOG_EVENT = _struct(timestamp=_S, level=_S, message=_S)
LOG_ANALYSIS = _struct(status=_S, file_status=_S, file_info=_struct(size=_S, last_modified=_S), issues=T.ArrayType(ISSUE), recent_events=T.ArrayType(LOG_EVENT))
LOG_LINE = _struct(file=_S, line_no=_L, raw=_S, ts=_TS, level=_S, message=_S)
RULE = _struct(pattern=_S, regex=_S, severity=_S, description=_S, recommended_action=_S, related_article=_S)
TRACE = _struct(event_id=_S, kind=_S, subject=_S, matched=_S, confidence=_D, outcome=_S, ts=_TS)

#: The domains of enumerated columns.
ACTIVITY_TYPES = ("search", "view", "alert", "system")
NOTIFICATION_TYPES = ("info", "warning", "error", "success")


def page_of(item: T.StructType) -> T.StructType:
    """A page of items with its pagination."""
    return T.StructType([T.StructField("items", T.ArrayType(item)), T.StructField("pagination", PAGINATION)])
