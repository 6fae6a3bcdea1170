"""Number, time and text rendering used in messages and exported columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """``value`` with a fixed number of decimals, exact ties to even.

    ``format_string('%.1f')`` rounds ties up; a decimal pattern rounds the exact
    binary value half-even, which is what the published messages show.
    """
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def plain_double(value: Column) -> Column:
    """Shortest decimal text of a double without an exponent (``12000000.0``)."""
    value = value.cast("double")
    # cast to decimal keeps the shortest digits; drop the zeros behind them
    long_form = F.regexp_replace(value.cast("decimal(38,9)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(F.abs(value) < 1e7, value.cast("string")).otherwise(long_form)


def iso_from_millis(millis: Column) -> Column:
    """Epoch milliseconds as ISO text in the session zone; empty when absent or zero."""
    stamp = F.timestamp_millis(millis)
    seconds = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return (
        F.when(F.coalesce(millis, F.lit(0)) == 0, F.lit(""))
        .when(millis % 1000 == 0, seconds)
        .otherwise(micros)
    )


def shorten(text: Column, limit: int) -> Column:
    """Cut to ``limit`` characters, the last three being dots."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))).otherwise(text)


def elapsed(unit: str, start: Column, end: Column) -> Column:
    """Whole units between two timestamps, truncated (NULL while either is missing)."""
    return F.timestamp_diff(unit, start, end)
