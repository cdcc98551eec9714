"""Labels of times, sizes and counts for people. An unknown value is a dash."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def _parts(total: Column) -> tuple[Column, Column, Column]:
    return F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60


def one_digit(x: Column) -> Column:
    """x with one digit after the point, as printf has it: what counts is the exact value of the double (2.05 is a little
    less and gives 2.0), and of two as near the even one. Spark's format_string rounds the shortest decimal text half up."""
    a = F.abs(x.cast("double"))
    whole = F.floor(a)
    part = a - whole
    k = F.floor(part * 10)
    over = (part * 16 - (2 * k + 1)) + part * 4  # the sign of 20 * part - (2k + 1), without rounding where it is near 0
    tenths = whole * 10 + k + F.when((over > 0) | ((over == 0) & (k % 2 == 1)), 1).otherwise(0)
    told = F.concat(F.when(x < 0, "-").otherwise(""), (tenths.cast("decimal(19,0)") * F.lit(Decimal("0.1"))).cast("string"))
    return F.when(a < 2.0**52, told).when(a.isNotNull(), F.format_string("%.1f", x.cast("double")))


def hms(seconds: Column) -> Column:
    """1h02m03s, 2m03s or 3s, rounded half up."""
    h, m, s = _parts(F.floor(seconds + 0.5))
    return F.coalesce(F.when(h > 0, F.format_string("%dh%02dm%02ds", h, m, s)).when(m > 0, F.format_string("%dm%02ds", m, s)).when(seconds.isNotNull(), F.format_string("%ds", s)), F.lit(DASH))


def clock(seconds: Column, rounded: bool = True) -> Column:
    """1:02:03 or 02:03; rounded half up, or cut and not below 0."""
    h, m, s = _parts(F.floor(seconds + 0.5) if rounded else F.floor(F.greatest(seconds, F.lit(0.0))))
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def time_left(work: Column, calendar: Column, evaluated: Column) -> Column:
    """What is left by the calendar, or where that is unknown as work; null work is a dash."""
    suffix = F.when(evaluated, "").otherwise(" (excl. eval)")
    told = F.when(calendar.isNotNull(), F.concat(rough(calendar), F.lit(" left"))).otherwise(F.concat(rough(work), F.lit(" work time (calendar depends on runner availability)")))
    return F.when(work.isNull(), DASH).otherwise(F.concat(told, suffix))


def rough(seconds: Column) -> Column:
    """Under an hour, whole hours up to two days, then days with one digit."""
    hours, fine = seconds / 3600, (seconds > 0) & ~F.isnan(seconds) & (seconds < float("inf"))
    told = F.when(hours < 1, "<1h").when(hours < 48, F.format_string("~%dh", F.floor(hours + 0.5))).otherwise(F.concat(F.lit("~"), one_digit(seconds / 86_400), F.lit(" days")))
    return F.when(fine, told).otherwise(DASH)


def size(n: Column) -> Column:
    """Bytes in units of 1024."""
    value, unit = F.lit(None).cast("double"), F.lit(None).cast("string")
    for k, letter in enumerate("KMGTPE", 1):
        value, unit = F.when(n >= 1024**k, n / float(1024**k)).otherwise(value), F.when(n >= 1024**k, f" {letter}B").otherwise(unit)
    return F.coalesce(F.concat(one_digit(value), unit), F.format_string("%d B", n))


def count(n: Column) -> Column:
    """A whole number with commas."""
    return F.format_number(n, 0)


def compact(n: Column) -> Column:
    """With commas below a million, then in M, B or T with one digit; the next unit begins where that would be 1000.0."""
    big, value, unit = F.abs(n.cast("double")), F.lit(None).cast("double"), F.lit(None).cast("string")
    for k, letter in enumerate("MBT"):
        reached = big >= (1e6 if k == 0 else 999.95 * 1000.0 ** (k + 1))
        value, unit = F.when(reached, n / (1e6 * 1000.0**k)).otherwise(value), F.when(reached, letter).otherwise(unit)
    return F.coalesce(F.concat(one_digit(value), unit), count(n))


def codec(name: Column, channels: Column) -> Column:
    """A codec's name and its channels in words."""
    word = F.when(channels == 1, "mono").when(channels == 2, "stereo").when(channels > 0, F.concat(channels.cast("string"), F.lit("ch")))
    joined = F.concat_ws(" · ", F.nullif(name, F.lit("")), word)
    return F.when(joined == "", DASH).otherwise(joined)


def memory(used_mb: Column, total_mb: Column) -> Column:
    return F.when(used_mb.isNull() | total_mb.isNull(), DASH).otherwise(F.concat(one_digit(used_mb / 1024.0), F.lit(" / "), one_digit(total_mb / 1024.0), F.lit(" GB")))
