"""Time as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without a time zone (the session's)."""
    return F.unix_micros(ts.cast("timestamp"))
