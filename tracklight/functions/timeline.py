"""A timeline's snap points and header, and instants as a viewer types them.

A timeline begins at `origin`, ends before `end` (dates), and has `px` pixels a day; places are pixels from its beginning.
The session's time zone is UTC, as for all instants of this engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracklight.functions.dates import timeline_x
from tracklight.model import parse_instant


def _monday_distance(day: Column) -> Column:
    """Days since the week's Monday."""
    return F.weekday(day)


#: What days of a timeline are snapped to.
SNAPS = {
    "day": lambda day: F.lit(True),
    "week": lambda day: _monday_distance(day).isin(0, 3),
    "month": lambda day: F.dayofmonth(day).isin(1, 8, 15, 22),
    "quarter": lambda day: F.dayofmonth(day) == 1,
}


def snap_points(origin: Column, end: Column, granularity: str, px: float) -> Column:
    """The places of the days that a granularity (day, week, month, quarter) snaps to, in order, the end included."""
    days = F.filter(F.sequence(origin, end), SNAPS[granularity])
    return F.transform(days, lambda d: timeline_x(d, origin, px))


def snap(x: Column, points: Column, threshold: float) -> Column:
    """The nearest of the points, the first of two as near, if it is within the threshold; else the place itself."""
    near = F.array_min(F.transform(points, lambda p: F.struct(F.abs(x - p).alias("far"), p.alias("x"))))
    return F.when(near["far"] <= threshold, near["x"]).otherwise(x)


def week_label(monday: Column, days: Column, mode: str = "both") -> Column:
    """`W31: Jul 30 – Aug 5`; mode weekNumber or dateRange gives one part of it."""
    last = F.date_add(monday, (days - 1).cast("int"))
    number = F.concat(F.lit("W"), F.weekofyear(monday).cast("string"))
    month = lambda d: F.date_format(d, "MMM")
    day = lambda d: F.dayofmonth(d).cast("string")
    one = F.concat(month(monday), F.lit(" "), day(monday), F.lit("–"), day(last))
    two = F.concat(month(monday), F.lit(" "), day(monday), F.lit(" – "), month(last), F.lit(" "), day(last))
    dates = F.when(F.month(monday) == F.month(last), one).otherwise(two)
    return {"weekNumber": number, "dateRange": dates}.get(mode, F.concat(number, F.lit(": "), dates))


def weeks(origin: Column, end: Column, px: float, mode: str = "both") -> Column:
    """array of struct(label, x, width): a timeline's weeks; the first begins at its beginning, and the last ends where it ends."""
    starts = F.filter(F.sequence(origin, F.date_sub(end, 1)), lambda d: (d == origin) | (_monday_distance(d) == 0))

    def band(d: Column) -> Column:
        whole = F.lit(7) - _monday_distance(d)
        days = F.when((d == origin) & (whole < 7), whole).otherwise(F.least(whole, F.datediff(end, d)))
        return F.struct(week_label(d, days, mode).alias("label"), timeline_x(d, origin, px).alias("x"), (days * F.lit(float(px))).alias("width"))

    return F.when(origin < end, F.transform(starts, band))


#: Unit of a band: how it is cut from a date, its months, and its label.
BANDS = {
    "month": ("MM", 1, lambda d: F.date_format(d, "MMM")),
    "month_year": ("MM", 1, lambda d: F.date_format(d, "MMM yy")),
    "quarter": ("QUARTER", 3, lambda d: F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit(" "), F.year(d).cast("string"))),
    "year": ("YEAR", 12, lambda d: F.year(d).cast("string")),
}


def bands(origin: Column, end: Column, px: float, unit: str) -> Column:
    """array of struct(label, x, width): a timeline's months (month, month_year), quarters or years, cut at its ends."""
    cut, months, text = BANDS[unit]
    starts = F.sequence(F.trunc(origin, cut), F.date_sub(end, 1), F.make_interval(months=F.lit(months)))

    def band(d: Column) -> Column:
        first, last = F.greatest(d, origin), F.least(F.add_months(d, months), end)
        x = timeline_x(first, origin, px)
        return F.struct(text(d).alias("label"), x.alias("x"), (timeline_x(last, origin, px) - x).alias("width"))

    return F.when(origin < end, F.transform(starts, band))


def local_input(instant: Column | str, zone: str) -> Column:
    """An instant as the text of a date and time field in a viewer's zone, to the minute; '' where unset or unreadable."""
    there = F.from_utc_timestamp(F.timestamp_millis(parse_instant(instant)), zone)
    return F.coalesce(F.date_format(there, "yyyy-MM-dd'T'HH:mm"), F.lit(""))


def from_local_input(value: Column | str, zone: str) -> Column:
    """The instant, in ISO text with milliseconds, of a field's date and time in a viewer's zone; '' where unset or unreadable."""
    value = F.col(value) if isinstance(value, str) else value
    wall = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"), value.try_cast("timestamp"))
    return F.coalesce(F.date_format(F.to_utc_timestamp(wall, zone), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(""))
