"""Dates of mail items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 100 ns ticks from 1601 to 1970.
EPOCH_TICKS = 116444736000000000


def filetime_micros(ticks: Column) -> Column:
    return F.call_function("div", ticks - F.lit(EPOCH_TICKS), F.lit(10))


def filetime_timestamp(ticks: Column) -> Column:
    return F.timestamp_micros(filetime_micros(ticks))


def filetime_rfc2822(ticks: Column) -> Column:
    """In UTC whatever the session's zone; null for a null or negative count."""
    utc = F.to_utc_timestamp(filetime_timestamp(ticks), F.current_timezone())
    return F.when(ticks >= 0, F.concat(F.date_format(utc, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")))


def filetime_text(ticks: Column) -> Column:
    """What record families show of a FILETIME."""
    return F.concat(F.lit("filetime:"), ticks.cast("string"))


def first_date(transport: Column, sent: Column, received: Column) -> Column:
    """X52."""
    return F.coalesce(transport, sent, received)


def adapter_date(header_date: Column, sent: Column, received: Column) -> Column:
    """The header's text as it stands, else the sent or received FILETIME as a date."""
    ticks = lambda c: F.regexp_extract(c, r"^filetime:(\d+)$", 1).try_cast("bigint")
    return F.coalesce(F.nullif(F.trim(header_date), F.lit("")), filetime_rfc2822(ticks(sent)), filetime_rfc2822(ticks(received)))
