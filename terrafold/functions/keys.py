"""Grouping keys: time groups, location-day blocks and seeded hashes of group values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basic import as_column


def is_blank(value) -> Column:
    x = as_column(value).cast("string")
    return x.isNull() | (F.trim(x) == "")


def day_text(value) -> Column:
    """Date as YYYY-MM-DD text; null if it cannot be read."""
    return F.date_format(as_column(value).try_cast("date"), "yyyy-MM-dd")


def time_group(date, event=None, prefix_dates: bool = True) -> Column:
    """``event:<id>`` where an event is given, else ``date:<day>``.

    Without an event column the fold splitter uses bare days, role assignment prefixed ones.
    """
    day = day_text(date)
    if event is None:
        return F.concat(F.lit("date:"), day) if prefix_dates else day
    return F.when(
        ~is_blank(event), F.concat(F.lit("event:"), as_column(event).cast("string"))
    ).otherwise(F.concat(F.lit("date:"), day))


def location_day(location, date) -> Column:
    """Composite block; null when a part is missing, which callers count and refuse."""
    a, b = as_column(location).cast("string"), as_column(date).cast("string")
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("location"), b.alias("day")))


def stable_hash(value, seed: int, salt: str) -> Column:
    """SHA-256 of ``seed|salt|value``; the order of groups in every seeded choice."""
    return F.sha2(F.concat(F.lit(f"{seed}|{salt}|"), as_column(value).cast("string")), 256)
