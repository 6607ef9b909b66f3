"""Epoch seconds (UTC) to calendar parts and back, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def breakdown(epoch: Column) -> dict[str, Column]:
    """Year, JulianDay, Month, Day, Hour (with its fraction) and Text of epoch seconds."""
    days = F.floor(epoch / 86400).cast("int")
    date = F.date_add(F.lit("1970-01-01").cast("date"), days)
    second = epoch - F.floor(epoch / 86400) * 86400
    whole = F.floor(second)
    pad = lambda x: F.lpad(x.cast("bigint").cast("string"), 2, "0")
    text = F.concat(F.date_format(date, "yyyy/MM/dd "), pad(F.floor(second / 3600)), F.lit(":"), pad(F.floor(whole / 60) % 60), F.lit(":"), pad(whole % 60))
    return {"Year": F.year(date), "JulianDay": F.dayofyear(date), "Month": F.month(date), "Day": F.dayofmonth(date), "Hour": second / 3600, "Text": text}


def epoch(year: Column, month: Column, day: Column, hour: Column) -> Column:
    return F.datediff(F.make_date(year, month, day), F.lit("1970-01-01").cast("date")).cast("double") * 86400 + hour * 3600


def epoch_of_julian(year: Column, julian_day: Column, hour: Column) -> Column:
    return epoch(year, F.lit(1), F.lit(1), hour) + (julian_day - 1) * 86400


def text_to_epoch(text: Column, pattern: str = "yyyy/MM/dd HH:mm:ss") -> Column:
    return F.unix_timestamp(F.to_timestamp(text, pattern)).cast("double")


def seconds_of(timestamp: Column) -> Column:
    """Epoch seconds of a timestamp, with or without time zone; the session's zone must be UTC for the latter."""
    return F.unix_micros(timestamp.cast("timestamp")) / 1e6
