"""The fixed mappings from one enumerated value to another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _case(value: Column, arms: dict[str, str], other: str) -> Column:
    out = None
    for k, v in arms.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out.otherwise(other)


def activity_class(kind: Column) -> Column:
    return _case(kind, {"alert": "error", "system": "warning", "search": "default"}, "success")


def dashboard_class(kind: Column) -> Column:
    """As on the dashboard, which has no arm of its own for searches."""
    return _case(kind, {"alert": "error", "system": "warning"}, "success")


def notification_type(status: Column) -> Column:
    """Anything but CRITICAL, OK included, is a warning."""
    return _case(status, {"CRITICAL": "error"}, "warning")


def issue_class(severity: Column) -> Column:
    return _case(severity, {"WARNING": "warning"}, "error")


def level_class(level: Column) -> Column:
    return _case(level, {"ERROR": "error", "WARN": "warning"}, "default")
