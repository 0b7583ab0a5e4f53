"""Scalar functions as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Take white space of any script off both ends (F.trim only takes spaces)."""
    return F.regexp_replace(F.regexp_replace(text, r"^[\s\p{Z}]+", ""), r"[\s\p{Z}]+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def or_else(value: Column, default: Column) -> Column:
    """`default` where the value is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), default)


#: Characters that URL components keep, by the escapes that form encoding gives them.
_KEPT = {"%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}


def url_component(text: Column) -> Column:
    """Percent-encoding of a URL component: a space is %20, and ! ' ( ) ~ stand for themselves."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, char in _KEPT.items():
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def iso_utc(ts: Column) -> Column:
    """ISO-8601 with milliseconds; in a session whose time zone is UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def from_iso(text: Column) -> Column:
    """The instant of an ISO-8601 text, or null."""
    return F.try_to_timestamp(text)


def display_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def json_or_empty(metadata: Column) -> Column:
    """A map as JSON; null becomes {}."""
    return F.to_json(F.coalesce(metadata, F.create_map().cast("map<string,string>")))


def content_id(*columns: Column | str) -> Column:
    """A reproducible id: nine characters of a hash of the contents."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *columns), 256), 1, 9)


def terms(text: Column) -> Column:
    """The distinct words of a text: lower-cased runs of ASCII letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != ""))
