"""Scheduling along dependencies: a case starts after the last of those that it depends on is due.

The graph is worked off in rounds, all cases at once whose predecessors are done; a round is a join and an aggregate,
so a project of any size and the hottest case are dealt over all tasks. There are as many rounds as the longest
chain has cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklight.model import Context, is_terminal
from tracklight.operators.common import checkpoint


def edges(cases: DataFrame) -> DataFrame:
    """id, dep for each dependency on a case that is there; repeated ones each count."""
    wanted = cases.select("id", F.explode("dependencies").alias("dep"))
    return wanted.join(cases.select(F.col("id").alias("dep")), "dep").select("id", "dep")


def downstream(cases: DataFrame, changed: str) -> DataFrame:
    """id: a case and all that depend on it, directly or not."""
    links = checkpoint(edges(cases))
    start = cases.sparkSession.range(1).select(F.lit(changed).alias("id"))
    seen = front = checkpoint(start)
    while not front.isEmpty():
        found = links.join(front.select(F.col("id").alias("dep")), "dep").select("id").distinct()
        front = checkpoint(found.join(seen, "id", "left_anti"))
        seen = checkpoint(seen.union(front))
    return seen


def would_create_cycle(cases: DataFrame, source: str, target: str) -> bool:
    """Whether `target` depends on `source`, directly or not, or is the same case."""
    return source == target or not downstream(cases, source).where(F.col("id") == target).isEmpty()


def _shifted(latest: Column, type_: Column, start: Column, due: Column) -> tuple[Column, Column]:
    """New start and due of a case whose predecessors' latest due date is `latest`."""
    earliest = F.date_add(latest, 1)
    milestone = (type_ == "milestone") | (start.isNull() & due.isNotNull())
    late_due = due.isNull() | (due < earliest)
    late = start < earliest
    new_start = F.when(milestone, start).when(start.isNull() | late, earliest).otherwise(start)
    moved = F.date_add(earliest, F.datediff(due, start))
    new_due = F.when(milestone & late_due, earliest).when(~milestone & late & due.isNotNull(), moved).otherwise(due)
    return new_start, new_due


def schedule(cases: DataFrame, ctx: Context, changed: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(patches, cyclic): patches has id, start_d, due_d of each case that moves; cyclic the id of each that a cycle holds up.

    With `changed`, only what depends on that case is looked at. Cases that are over stay where they are; archived
    predecessors, and those without a due date, hold nothing up. A case downstream of a cycle is held up too. A case that
    isn't a milestone but has only a due date is treated as one.
    """
    links = edges(cases)
    slim = cases.select(
        "id", "type", "start_d", "due_d", is_terminal(ctx).alias("over"), F.coalesce("archived", F.lit(False)).alias("archived")
    )
    if changed is not None:
        scope = downstream(cases, changed)
        slim_scope = slim.join(scope, "id", "left_semi")
        inner = links.join(scope, "id", "left_semi")
        fixed = inner.join(scope.withColumnRenamed("id", "dep"), "dep", "left_anti")
        inner = inner.join(scope.withColumnRenamed("id", "dep"), "dep", "left_semi")
        known = slim.select(F.col("id").alias("dep"), F.when(~F.col("archived"), F.col("due_d")).alias("due"))
        outside = fixed.join(known, "dep").groupBy("id").agg(F.max("due").alias("outer"))
    else:
        slim_scope, inner, outside = slim, links, None
    inner = checkpoint(inner)
    waits = inner.groupBy("id").agg(F.count("*").alias("waits"))
    state = slim_scope.join(waits, "id", "left").withColumn("waits", F.coalesce("waits", F.lit(0)).cast("long"))
    state = state.join(outside, "id", "left").withColumnRenamed("outer", "latest") if outside is not None else state.withColumn("latest", F.lit(None).cast("date"))
    state = checkpoint(state)
    done = []
    while True:
        ready = state.where("waits = 0")
        start, due = _shifted(F.col("latest"), F.col("type"), F.col("start_d"), F.col("due_d"))
        moves = F.col("latest").isNotNull() & ~F.col("over")
        ready = checkpoint(
            ready.select(
                "id",
                "archived",
                F.when(moves, start).otherwise(F.col("start_d")).alias("start_d"),
                F.when(moves, due).otherwise(F.col("due_d")).alias("due_d"),
                F.coalesce(moves & ~(start.eqNullSafe(F.col("start_d")) & due.eqNullSafe(F.col("due_d"))), F.lit(False)).alias("moved"),
            )
        )
        if ready.isEmpty():
            break
        done.append(ready.where("moved").select("id", "start_d", "due_d"))
        finished = ready.select(F.col("id").alias("dep"), F.when(~F.col("archived"), F.col("due_d")).alias("due"))
        news = inner.join(finished, "dep").groupBy("id").agg(F.count("*").alias("n"), F.max("due").alias("due"))
        state = state.where("waits > 0").join(news, "id", "left")
        state = checkpoint(
            state.withColumn("waits", F.col("waits") - F.coalesce("n", F.lit(0)))
            .withColumn("latest", F.greatest("latest", "due"))
            .drop("n", "due")
        )
    patches = cases.sparkSession.createDataFrame([], "id string, start_d date, due_d date")
    for part in done:
        patches = patches.union(part)
    return patches, state.where("waits > 0").select("id")


def link_allowed(cases: DataFrame, source: str, target: str) -> bool:
    """Whether a timeline link is neither there already nor the direct reverse of one."""
    pair = edges(cases).where(
        ((F.col("id") == target) & (F.col("dep") == source)) | ((F.col("id") == source) & (F.col("dep") == target))
    )
    return source != target and pair.isEmpty()


def arrows(cases: DataFrame, visible: Column) -> DataFrame:
    """source, target, source_due, target_start: dependencies both ends of which are visible and dated."""
    shown = cases.where(visible)
    before = shown.where("due_d is not null").select(F.col("id").alias("source"), F.col("due_d").alias("source_due"))
    after = shown.where("start_d is not null").select("id", "dependencies", F.col("start_d").alias("target_start"))
    after = after.select(F.col("id").alias("target"), "target_start", F.explode("dependencies").alias("source"))
    return after.join(before, "source").select("source", "target", "source_due", "target_start")
