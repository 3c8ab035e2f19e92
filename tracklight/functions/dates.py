"""Calendar functions of due dates, weeks and timelines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracklight.model import Context, is_terminal


def iso_week_label(day: Column) -> Column:
    """`2026-W31`, the ISO week of a date."""
    return F.concat(F.date_part(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def utc_date(ms: Column) -> Column:
    return F.timestamp_millis(ms).cast("date")


def week_end(ctx: Context) -> Column:
    """The last day of the window `this week`: the coming Sunday; on a Sunday that of the next week."""
    weekday = (F.dayofweek(ctx.today_col) + 5) % 7 + 1  # Monday 1 to Sunday 7
    return F.date_add(ctx.today_col, (F.lit(7) - weekday % 7).cast("int"))


def _days(due: Column, ctx: Context) -> Column:
    return F.datediff(due, ctx.today_col)


def relative_due(ctx: Context, due: str = "due_d") -> Column:
    """`3d overdue`, `Today`, `Tomorrow`, `In 4d` up to six days ahead; null otherwise."""
    n = _days(F.col(due), ctx)
    return (
        F.when(n < 0, F.concat((-n).cast("string"), F.lit("d overdue")))
        .when(n == 0, "Today")
        .when(n == 1, "Tomorrow")
        .when(n <= 6, F.concat(F.lit("In "), n.cast("string"), F.lit("d")))
    )


def completion_outcome() -> Column:
    """`2d late` or `On time` for a completed case with a due date; null otherwise."""
    n = F.datediff("completed_d", "due_d")
    return F.when(n > 0, F.concat(n.cast("string"), F.lit("d late"))).when(n <= 0, "On time")


def due_urgency(ctx: Context) -> Column:
    """overdue, near (within three days) or normal; what is over, or has no due date, is normal."""
    n = _days(F.col("due_d"), ctx)
    return F.when(is_terminal(ctx) | n.isNull(), "normal").when(n < 0, "overdue").when(n < 3, "near").otherwise("normal")


def timeline_x(day: Column, origin: Column, pixels_a_day: float) -> Column:
    """Place of a date on a timeline."""
    return F.datediff(day, origin) * F.lit(float(pixels_a_day))


def timeline_date(x: Column, origin: Column, pixels_a_day: float) -> Column:
    """The date at a place on a timeline: that of the nearest day."""
    return F.date_add(origin, F.round(x / F.lit(float(pixels_a_day))).cast("int"))


def bar(origin: Column, pixels_a_day: float, least_width: float = 8.0) -> Column:
    """struct(x, width, done_width): a case's bar, its last day included; null without both dates."""
    x = timeline_x(F.col("start_d"), origin, pixels_a_day)
    end = timeline_x(F.date_add("due_d", 1), origin, pixels_a_day)
    width = F.greatest(end - x, F.lit(least_width))
    done = width * F.least(F.greatest(F.col("progress"), F.lit(0.0)), F.lit(100.0)) / 100
    return F.when(
        F.col("start_d").isNotNull() & F.col("due_d").isNotNull(), F.struct(x.alias("x"), width.alias("width"), done.alias("done_width"))
    )
