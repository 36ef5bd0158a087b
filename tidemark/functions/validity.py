"""Parsing and validity of text, dates and UTC timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """Trimmed text, blank becomes NULL."""
    return F.nullif(F.trim(x.cast("string")), F.lit(""))


def parse_date(x: Column) -> Column:
    """Strict yyyy-MM-dd; anything else is NULL."""
    x = clean(x)
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(x, "yyyy-MM-dd"))


def parse_utc(x: Column) -> Column:
    """Timestamp text whose offset is zero; other offsets and naive times are NULL."""
    x = clean(x)
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}T.*(Z|\+00:00)$"), F.try_to_timestamp(x))


def japan_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, "Asia/Tokyo"))


def end_of_japan_day(d: Column) -> Column:
    """Last millisecond of an accounting day in Japan, as a UTC timestamp."""
    midnight = F.to_utc_timestamp(F.date_add(d, 1).cast("timestamp"), "Asia/Tokyo")
    return midnight - F.expr("INTERVAL 1 MILLISECOND")


def start_of_japan_day(d: Column) -> Column:
    return F.to_utc_timestamp(d.cast("timestamp"), "Asia/Tokyo")
