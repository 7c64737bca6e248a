"""Timestamps of the contract: RFC 3339 in UTC, and the two log formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339_UTC = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,9})?(?:Z|[+-]00:00)$"
LOG = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,9})?[+-][0-9]{4}$"


def rfc3339_utc(text: Column) -> Column:
    """The timestamp, to the microsecond; null if the text is no such time or not in UTC."""
    whole = F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]{6})[0-9]+", "$1"), r"(?:Z|[+-]00:00)$", "+00:00")
    return F.when(text.rlike(RFC3339_UTC), F.try_to_timestamp(whole))


def log_epoch(text: Column) -> Column:
    """Seconds since 1970 of a log's time with its offset; null if the text is none."""
    seconds = F.try_to_timestamp(F.regexp_replace(text, r"\.[0-9]+", ""), F.lit("yyyy-MM-dd HH:mm:ssZ")).cast("double")
    fraction = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, r"(\.[0-9]{1,9})", 1), F.lit("")), F.lit(".999999999")).cast("double"), F.lit(0.0))
    return F.when(text.rlike(LOG), seconds + fraction)
