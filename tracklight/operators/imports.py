"""Foreign task records as cases."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FREQUENCIES = ("DAILY", "WEEKLY", "MONTHLY", "YEARLY")


def recurrence(rule: Column) -> Column:
    """struct(interval, every) of a simple rule; null for one without a known frequency."""
    frequency = F.regexp_extract(rule, rf"FREQ=({'|'.join(FREQUENCIES)})", 1)
    every = F.coalesce(F.regexp_extract(rule, r"INTERVAL=(\d+)", 1).try_cast("int"), F.lit(1))
    return F.when(frequency != "", F.struct(F.lower(frequency).alias("interval"), every.alias("every")))


def map_records(records: DataFrame, task_tag: str, archive_tag: str, status: str = "todo", priority: str = "medium", now: str = "") -> DataFrame:
    """Cases of records: path, title, status, priority, scheduled, due, completed, time_estimate (minutes), tags, recurrence, archived.

    Dates are cut to days, the marking tags go, minutes become hours of two places. Columns created and modified, where there are any,
    are the case's instants; a record without one has `now`.
    """
    day = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, 10)
    name = F.regexp_replace(F.regexp_replace("path", r"^.*/", ""), r"\.md$", "")
    some = lambda c, other: F.when(F.coalesce(c, F.lit("")) != "", F.col(c)).otherwise(other)
    none = F.expr("slice(array(''), 1, 0)")
    instant = lambda c: some(c, F.lit(now)) if c in records.columns else F.lit(now)
    return records.select(
        "path",
        some("title", name).alias("title"),
        some("status", F.lit(status)).alias("status"),
        some("priority", F.lit(priority)).alias("priority"),
        day("scheduled").alias("start"),
        day("due").alias("due"),
        day("completed").alias("completed"),
        F.filter(F.coalesce("tags", none), lambda t: ~t.isin(task_tag, archive_tag)).alias("tags"),
        recurrence(F.col("recurrence")).alias("recurrence"),
        F.when(F.col("time_estimate") > 0, F.round(F.col("time_estimate") / 60, 2)).alias("time_estimate"),
        F.coalesce("archived", F.lit(False)).alias("archived"),
        instant("created").alias("created_at"),
        instant("modified").alias("updated_at"),
    )


def build_forest(records: DataFrame) -> DataFrame:
    """path, parent, dependencies of the records of each batch (batch, pos, path, parents, blocked_by).

    The first parent that is in the batch holds; one that would close a cycle leaves its record at the root (''), in the order
    of the records. Dependencies outside the batch are dropped. A batch is what one person imports at once.
    """

    def link(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        inside, above = set(rows["path"]), {}
        for path, parents in zip(rows["path"], rows["parents"]):
            wanted = next((p for p in (parents if parents is not None else ()) if p in inside and p != path), "")
            up = wanted
            while up and up != path:
                up = above.get(up, "")
            above[path] = "" if up == path else wanted
        blocked = [[b for b in (x if x is not None else ()) if b in inside and b != p] for p, x in zip(rows["path"], rows["blocked_by"])]
        return pd.DataFrame({"batch": rows["batch"], "path": rows["path"], "parent": [above[p] for p in rows["path"]], "dependencies": blocked})

    schema = "batch string, path string, parent string, dependencies array<string>"
    return records.select("batch", "pos", "path", "parents", "blocked_by").groupBy("batch").applyInPandas(link, schema)


