"""Zone-less timestamps from the text forms that occur in the archives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^\s*\d{1,4}-\d{1,2}-\d{1,2}"
_US = r"^(\d{1,2})/(\d{1,2})/(\d{4})(?: (\d{1,2}:\d{1,2}(?::\d{1,2})?))?$"
_US_SHORT = r"^(\d{1,2})/(\d{1,2})/(\d{2}) (\d{1,2}:\d{1,2}(?::\d{1,2})?)$"


def parse_timestamp(value: Column) -> Column:
    """ISO date-times, then month/day/year with a four- or two-digit year.

    The slash forms are rewritten to ISO text and cast, so nothing depends on
    the session time zone and a date that does not exist gives NULL.  Two-digit
    years follow the usual pivot: 69-99 are 19xx, 00-68 are 20xx.
    """
    us = F.regexp_replace(value, _US, "$3-$1-$2 $4")
    short_year = F.regexp_extract(value, _US_SHORT, 3)
    century = F.when(short_year >= "69", "19").otherwise("20")
    short = F.concat(century, F.regexp_replace(value, _US_SHORT, "$3-$1-$2 $4"))
    text = (
        F.when(value.rlike(_ISO), value)
        .when(value.rlike(_US), us)
        .when(value.rlike(_US_SHORT), short)
    )
    return text.try_cast("timestamp_ntz")


def parse_double(value: Column) -> Column:
    """Plain decimal numbers only; type suffixes such as ``41.9d`` give NULL."""
    number = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    return F.when(value.rlike(number), value.try_cast("double"))


def month_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def valid_trip(started: Column, ended: Column) -> Column:
    """Both times known and not reversed; a zero duration is valid."""
    return F.coalesce(ended >= started, F.lit(False))


def trip_state(started: Column, ended: Column) -> Column:
    """untimed, reversed, zero or forward; the last two are valid trips."""
    return (
        F.when(started.isNull() | ended.isNull(), "untimed")
        .when(ended < started, "reversed")
        .when(ended == started, "zero")
        .otherwise("forward")
    )
