from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandem.functions.common import as_col


def elapsed(start, end) -> tuple[Column, Column]:
    """Whole minutes and remaining whole seconds between two timestamps."""
    us = F.timestamp_diff("MICROSECOND", as_col(start), as_col(end))
    minutes = F.floor(us / F.lit(60_000_000)).cast("long")
    seconds = F.floor((us - minutes * 60_000_000) / F.lit(1_000_000)).cast("long")
    return minutes, seconds
