"""Time codes, durations and calendar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fields(ms: Column) -> tuple[Column, Column, Column, Column]:
    ms = F.greatest(ms.cast("long"), F.lit(0).cast("long"))
    return F.floor(ms / 3_600_000).cast("long"), F.pmod(F.floor(ms / 60_000), F.lit(60)).cast("long"), F.pmod(F.floor(ms / 1000), F.lit(60)).cast("long"), F.pmod(ms, F.lit(1000))


def timecode(ms: Column, style: str = "clock") -> Column:
    """``clock``: hh:mm:ss, half a second rounds up; ``vtt``: hh:mm:ss.mmm; ``srt``: hh:mm:ss,mmm. Hours may pass 24."""
    if style == "clock":
        h, m, s, _ = _fields(F.floor((ms + 500) / 1000) * 1000)
        return F.format_string("%02d:%02d:%02d", h, m, s)
    h, m, s, rest = _fields(ms)
    return F.format_string("%02d:%02d:%02d" + ("." if style == "vtt" else ",") + "%03d", h, m, s, rest)


def parse_timecode(value: Column) -> Column:
    """Milliseconds of ``[h:]mm:ss[.,]mmm``; null if it is none."""
    clean = F.translate(F.trim(value), ",", ".")
    parts = F.split(clean, ":")
    seconds = F.try_element_at(parts, F.lit(-1)).try_cast("double") * 1000
    minutes = F.try_element_at(parts, F.lit(-2)).try_cast("long") * 60_000
    hours = F.when(F.size(parts) == 3, F.try_element_at(parts, F.lit(-3)).try_cast("long") * 3_600_000).when(F.size(parts) == 2, F.lit(0))
    return F.floor(seconds + minutes + hours + 0.5).cast("long")


def iso_duration(ms: Column) -> Column:
    """``PT1H2M3S``: zero hours and minutes are left out."""
    h, m, s, _ = _fields(F.floor((ms + 500) / 1000) * 1000)
    return F.concat(F.lit("PT"), F.when(h > 0, F.format_string("%dH", h)).otherwise(""), F.when(m > 0, F.format_string("%dM", m)).otherwise(""), F.format_string("%dS", s))


def weekday_after(day: Column, weekday: int, following_week: bool = False) -> Column:
    """The next such weekday (0 = Monday), never the day itself; with ``following_week`` the one of the next ISO week."""
    if following_week:
        return F.date_add(F.date_sub(day, F.weekday(day)), 7 + weekday)
    return F.date_add(day, F.pmod(F.lit(weekday - 1) - F.weekday(day), F.lit(7)) + 1)


def end_of_week(day: Column, weeks_ahead: int = 0) -> Column:
    """This week's Friday, or a later one; a Saturday or Sunday goes on to the next Friday."""
    return F.date_add(day, F.pmod(F.lit(4) - F.weekday(day), F.lit(7)) + 7 * weeks_ahead)


def end_of_month(day: Column, months_ahead: int = 0) -> Column:
    return F.last_day(F.add_months(day, months_ahead))


def calendar_date(day: Column, month: Column, reference: Column) -> Column:
    """That day and month of the reference's year, or of the next one if it is past; null if there is no such day."""
    this = F.try_make_timestamp(F.year(reference), month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    following = F.try_make_timestamp(F.year(reference) + 1, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    return F.when(this >= reference, this).otherwise(following)
