"""The SLA clock of incidents, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracklight.model import Context

#: A running clock is at risk when less than this fraction of its span is left.
WARN = 0.25


def _minutes(ctx: Context, which: int, severity: Column) -> Column:
    pairs = [x for sev, m in ctx.sla.items() for x in (F.lit(sev), F.lit(m[which]).cast("long"))]
    return F.element_at(F.create_map(*pairs), severity) if pairs else F.lit(None).cast("long")


def sla_state(ctx: Context) -> Column:
    """struct(phase, deadline_ms, remaining_ms, breached, done, span_ms), or null where no clock applies.

    A clock needs an incident with a severity that has a policy, and an anchor: detected_at, or created_at where that is
    unset. A detected_at that can't be read is no anchor at all. A resolved incident's clock stands;
    else it runs to the first response, then to the resolution.
    """
    response, resolution = (_minutes(ctx, i, F.col("severity")) * 60_000 for i in (0, 1))
    unset = F.coalesce(F.col("detected_at"), F.lit("")) == ""
    anchor = F.when(unset, F.col("created_ms")).otherwise(F.col("detected_ms"))
    resolved, responded = (F.coalesce(F.col(f"{x}_at"), F.lit("")) != "" for x in ("resolved", "responded"))
    responding = ~resolved & ~responded
    span = F.when(responding, response).otherwise(resolution)
    deadline = anchor + span
    at = F.when(resolved, F.col("resolved_ms")).otherwise(ctx.now_col)
    applies = (F.col("issue_type") == "incident") & anchor.isNotNull() & span.isNotNull()
    return F.when(
        applies,
        F.struct(
            F.when(responding, "response").otherwise("resolution").alias("phase"),
            deadline.alias("deadline_ms"),
            (deadline - at).alias("remaining_ms"),
            F.coalesce(at > deadline, F.lit(False)).alias("breached"),
            resolved.alias("done"),
            span.alias("span_ms"),
        ),
    )


def at_risk(state: Column) -> Column:
    """Whether a clock runs and is breached or has less than WARN of its span left."""
    near = state["breached"] | (state["remaining_ms"] < state["span_ms"] * WARN)
    return F.coalesce(state.isNotNull() & ~state["done"] & near, F.lit(False))


def sla_bucket(state: Column) -> Column:
    """breached, warn, ok, or none where no clock applies."""
    return (
        F.when(state.isNull(), "none").when(state["breached"], "breached").when(at_risk(state), "warn").otherwise("ok")
    )


def format_remaining(ms: Column) -> Column:
    """`2h 05m`, `37m`, or `+1h 12m` beyond the deadline; whole minutes."""
    minutes = F.floor(F.abs(ms) / 60_000)
    hours, rest = F.floor(minutes / 60).cast("string"), (minutes % 60).cast("string")
    body = F.when(minutes >= 60, F.concat(hours, F.lit("h "), F.lpad(rest, 2, "0"), F.lit("m"))).otherwise(
        F.concat(rest, F.lit("m"))
    )
    return F.when(ms < 0, F.concat(F.lit("+"), body)).otherwise(body)


def chip(state: Column) -> Column:
    """struct(text, warn, breach, live): what a case's chip says; null without a clock, or if resolved in time."""
    left = format_remaining(state["remaining_ms"])
    verb = F.when(state["phase"] == "response", "Respond ").otherwise("Resolve ")
    late = F.struct(
        F.concat(F.lit("Breached "), left).alias("text"), F.lit(False).alias("warn"), F.lit(True).alias("breach"), F.lit(False).alias("live")
    )
    running = F.struct(
        F.concat(verb, left).alias("text"),
        (~state["breached"] & at_risk(state)).alias("warn"),
        state["breached"].alias("breach"),
        F.lit(True).alias("live"),
    )
    return F.when(~state["done"], running).when(state["done"] & state["breached"], late)


def sla_sort(ctx: Context, state: Column, terminal: Column) -> list[Column]:
    """Sort keys: running clocks by what is left, then cases without a clock, then those that are over."""
    over = terminal | F.coalesce(state["done"], F.lit(False))
    bucket = F.when(over, 2).when(state.isNull(), 1).otherwise(0)
    return [bucket, F.when(bucket == 0, state["remaining_ms"]).otherwise(F.lit(0).cast("long"))]
