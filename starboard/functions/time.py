"""Epoch seconds to calendar values, always in UTC whatever the session's zone is."""

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def utc_timestamp(seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, F.expr(EPOCH))


def utc_seconds(timestamp: Column) -> Column:
    return F.timestamp_diff("SECOND", F.expr(EPOCH), timestamp.cast("timestamp_ntz"))


def rating_date(seconds: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss"""
    return utc_timestamp(seconds).cast("string")


def rating_year(seconds: Column) -> Column:
    return F.year(utc_timestamp(seconds))


def rating_month(seconds: Column) -> Column:
    return F.month(utc_timestamp(seconds))


def load_timestamp() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
