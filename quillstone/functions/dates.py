"""Date expressions, in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the stored form of "no date".
NO_DATE = "0101-01-01T00:00:00+00:00"


def day_number(iso: Column) -> Column:
    """Days since 1970 of an ISO time, whose offset is not looked at; null where it can't be read."""
    plain = F.replace(F.substring_index(iso, "+", 1), F.lit("T"), F.lit(" "))
    return F.floor(F.unix_timestamp(F.try_to_timestamp(plain)) / 86400).cast("long")


def known_date(iso: Column) -> Column:
    return F.nullif(iso, F.lit(NO_DATE))


def day_of(ts: Column) -> Column:
    return F.floor(F.unix_timestamp(ts.cast("timestamp")) / 86400).cast("long")
