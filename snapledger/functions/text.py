"""Text forms of numbers, times and records, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS = 1_000_000_000


def number_text(number: Column, width: int = 0) -> Column:
    """Thousands separators, padded on the left to ``width``; longer text is never cut."""
    text = F.format_number(number, 0)
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, " "))


def time_text(mtime_ns: Column, zone: str = "UTC", friendly: bool = True) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` in ``zone``, or ``yyyy-MM-dd_HH-mm-ss`` for names."""
    seconds = (mtime_ns - F.pmod(mtime_ns, F.lit(NANOS))) / NANOS
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    utc = epoch + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    text = F.substring(local.cast("string"), 1, 19)
    return text if friendly else F.translate(text, " :", "_-")


def elapsed_seconds(start_ns: Column, stop_ns: Column) -> Column:
    """Whole seconds between two nanosecond times, cut towards zero."""
    span = stop_ns - start_ns
    return (F.signum(span) * F.floor(F.abs(span) / F.lit(NANOS))).cast("long")


def elapsed_text(start_ns: Column, stop_ns: Column) -> Column:
    return F.concat(elapsed_seconds(start_ns, stop_ns).cast("string"), F.lit("s"))


def record_text(size: Column, mtime_ns: Column, path: Column, zone: str = "UTC") -> Column:
    """Size in 15 places, time in 19, then the path; blanks where a value is not set."""
    return F.concat_ws(
        " ",
        F.coalesce(number_text(size, 15), F.lit(" " * 15)),
        F.coalesce(time_text(mtime_ns, zone), F.lit(" " * 19)),
        path,
    )


def snapshot_name(name: Column, suffix: str | None = None) -> Column:
    return F.concat(name, F.lit("_" + suffix)) if suffix else name


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)
