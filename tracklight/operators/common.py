"""Plumbing that several operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checkpoint(df: DataFrame) -> DataFrame:
    """A written copy of `df` in the folder of spark.checkpoint.dir; where that is unset, in a temporary one on a local master only."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, groups: list[str], order: list[Column | str], name: str) -> DataFrame:
    """`df` with each row's place in its group, from 1, however large a group is; the group's columns hold no null.

    Rows are range-partitioned by group and order, so that a large group lies in many tasks. Places within a task's rows
    follow the counts of the tasks before it, of which there is a row for each group and task. Ties of the whole order are in any order.
    """
    rows = checkpoint(df.repartitionByRange(*groups, *order).withColumn("_task", F.spark_partition_id()))
    before = Window.partitionBy(*groups).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*groups, "_task").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*groups, "_task").orderBy(*order)))
    placed = placed.join(counts.drop("_n"), [*groups, "_task"])
    return placed.withColumn(name, F.col("_before") + F.col("_place")).select(*df.columns, name)


def recursive(df: DataFrame, sql: str, **more: DataFrame) -> DataFrame:
    """A recursive query over {c}, in which no row limit stops a large forest."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(sql, c=df, **more)
