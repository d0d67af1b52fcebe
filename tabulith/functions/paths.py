"""Comparable spelling of file locations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def same_file(path: Column) -> Column:
    """One spelling for all spellings of a file: s3, s3a and s3n are one scheme, repeated slashes and ``.`` segments
    mean nothing, ``file:/`` equals ``file:///``. Letter case is kept. NULL stays NULL, an empty text stays empty."""
    scheme = F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.\-]*):/", 1)
    rest = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.\-]*:/", "/")
    rest = F.regexp_replace(F.regexp_replace(rest, r"(?:/\.)+(?=/|$)", ""), r"/{2,}", "/")
    return F.when(scheme == "", rest).otherwise(F.concat(F.when(scheme.isin("s3a", "s3n"), "s3").otherwise(scheme), F.lit(":"), rest))


def month_of_millis(ms: Column) -> Column:
    """``YYYY-MM`` in UTC of epoch milliseconds, whatever the session's time zone."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int")), "yyyy-MM")


def month_of_ntz(ts: Column) -> Column:
    """``YYYY-MM`` of a timestamp without zone."""
    return F.date_format(ts.cast("date"), "yyyy-MM")
