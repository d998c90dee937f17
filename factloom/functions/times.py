"""Moments as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(at: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone (read in the session's)."""
    return F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp"))
