"""Times as the library writes them.  Operators take them as values, so that results do not hang on the clock."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_now(at: datetime | None = None) -> str:
    """Seconds in UTC by ISO 8601."""
    return (at or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def timestamp_tag(at: datetime | None = None) -> str:
    """Fourteen digits, for names."""
    return (at or datetime.now(UTC)).astimezone(UTC).strftime("%Y%m%d%H%M%S")


def parse_iso_time(text: Column) -> Column:
    """The moment that such a text names, whatever the session's zone; null for other texts."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
