"""Time codes, frame numbers and rounding on BIGINT microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000


def seconds(value: float) -> int:
    """Constant seconds to microseconds."""
    return round(value * SECOND)


def clamp(value: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(low, F.least(high, value))


def idiv(a: Column, b) -> Column:
    """Integer floor division of non-negative values, kept in BIGINT."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def half_up(value: Column) -> Column:
    return F.floor(value + F.lit(0.5)).cast("bigint")


def format_timecode(us: Column) -> Column:
    """``[-]mm:ss.mmm``, milliseconds rounded half up with carry."""
    ms = idiv(F.abs(us) + F.lit(500), 1000)
    return F.concat(
        F.when(us < 0, "-").otherwise(""),
        _pad(idiv(ms, 60_000), 2),
        F.lit(":"),
        _pad(idiv(ms % 60_000, 1000), 2),
        F.lit("."),
        _pad(ms % 1000, 3),
    )


def _pad(n: Column, width: int) -> Column:
    text = n.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def parse_timecode(text: Column) -> Column:
    """Microseconds of ``[-][m:]s[.mmm]``; null when the text has another form."""
    s = F.trim(text)
    pattern = "^(-?)(?:([0-9]+):)?([0-9]+)(?:\\.([0-9]{1,3}))?$"

    def group(i: int) -> Column:
        return F.regexp_extract(s, pattern, i)

    def number(c: Column) -> Column:
        return F.when(c == "", F.lit(0)).otherwise(F.try_to_number(c, F.lit("9" * 18)).cast("bigint"))

    total = (number(group(2)) * 60 + number(group(3))) * SECOND
    total = total + number(F.rpad(group(4), 3, "0")) * 1000
    signed = F.when(group(1) == "-", -total).otherwise(total)
    return F.when(s.rlike(pattern), signed)


def to_frame(us: Column, fps: int) -> Column:
    return half_up(us * F.lit(fps) / F.lit(SECOND))


def frame_start(frame: Column, fps: int) -> Column:
    return half_up(frame * F.lit(SECOND) / F.lit(fps))
