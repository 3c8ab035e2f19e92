"""Catalogs of a project: its own list where it has one, else the global one, and ids that cases use beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklight.model import STATUS_IDS, TERMINAL_IDS
from tracklight.operators.common import checkpoint

#: Most projects whose catalogs are broadcast; beyond it Catalyst joins by project, and AQE splits those with many cases.
BROADCAST_PROJECTS = 50_000


def resolve(own: DataFrame, default: DataFrame, in_use: DataFrame) -> DataFrame:
    """project_id, pos, id, label, complete of each project's catalog.

    own has project_id, ord, id, label, complete; default the same without project_id; in_use has project_id, id and
    first_pos, for every project. A project's own list holds if it has any; ids in use that it lacks follow in
    the order of the tree, as the default list has them, or else under their id, not complete.
    """
    projects = in_use.select("project_id").union(own.select("project_id")).distinct()
    with_own = own.select("project_id").distinct()
    inherits = projects.join(with_own, "project_id", "left_anti")
    base = own.select("project_id", "ord", "id", "label", "complete").union(
        inherits.join(F.broadcast(default)).select("project_id", "ord", "id", "label", "complete")
    )
    extra = in_use.where("id is not null and id <> ''").join(base.select("project_id", "id"), ["project_id", "id"], "left_anti")
    known = default.select("id", F.col("label").alias("_l"), F.col("complete").alias("_c"))
    extra = extra.join(F.broadcast(known), "id", "left").select(
        "project_id", F.lit(1).alias("part"), F.col("first_pos").alias("at"), "id",
        F.coalesce("_l", "id").alias("label"), F.coalesce("_c", F.lit(False)).alias("complete"),
    )
    rows = base.select("project_id", F.lit(0).alias("part"), F.col("ord").cast("long").alias("at"), "id", "label", "complete").union(extra)
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("part", "at", "id"))
    return rows.select("project_id", place.alias("pos"), "id", "label", "complete")


def in_use(cases: DataFrame, column: str = "status") -> DataFrame:
    """project_id, id, first_pos of what cases use, as resolve() takes it; first in the order of tree_pos where there is one, else of ord."""
    place = next(c for c in ("tree_pos", "ord") if c in cases.columns)
    return cases.groupBy("project_id", F.col(column).alias("id")).agg(F.min(place).alias("first_pos"))


def attach(cases: DataFrame, catalog: DataFrame) -> DataFrame:
    """`cases` with their project's status_ids and terminal_ids, for operators with a context of per_project=True.

    catalog is resolve()'s: project_id, pos, id, complete; one row is made of a project's, as many elements long as its settings
    have statuses. A case of a project without a catalog has null lists: it's never over and its status is unknown.
    """
    entries = F.array_sort(F.collect_list(F.struct("pos", "id", F.coalesce("complete", F.lit(False)).alias("complete"))))
    lists = catalog.groupBy("project_id").agg(entries.alias("_e")).select(
        F.col("project_id").alias("_p"), F.col("_e.id").alias(STATUS_IDS), F.filter("_e", lambda e: e["complete"])["id"].alias(TERMINAL_IDS)
    )
    lists = checkpoint(lists)
    few = lists.limit(BROADCAST_PROJECTS + 1).count() <= BROADCAST_PROJECTS
    out = cases.drop(STATUS_IDS, TERMINAL_IDS)
    return out.join(F.broadcast(lists) if few else lists, F.col("project_id") == F.col("_p"), "left").drop("_p")


def upsert_palette(catalog: DataFrame, incoming: DataFrame, in_use: DataFrame) -> DataFrame:
    """ord, id, label of a catalog with a foreign palette: known ids take its label, new ones follow the last known before them.

    incoming has ord, id, label; in_use has id: those in neither list come last, under their id.
    """
    old = catalog.select("id", F.col("ord").alias("old_ord"), F.col("label").alias("old_label"))
    new = incoming.select("id", F.col("ord").alias("new_ord"), F.col("label").alias("new_label"))
    both = old.join(new, "id", "full")
    w = Window.orderBy("new_ord").rowsBetween(Window.unboundedPreceding, 0)  # a catalog is a short list
    anchored = both.where("new_ord is not null").withColumn("anchor", F.last("old_ord", ignorenulls=True).over(w))
    kept = both.where("new_ord is null").withColumn("anchor", F.col("old_ord"))
    rows = anchored.unionByName(kept).select(
        F.coalesce("anchor", F.lit(-1)).alias("a"), F.when(F.col("old_ord").isNull(), F.coalesce("new_ord", F.lit(0)) + 1).otherwise(0).alias("b"),
        "id", F.coalesce("new_label", "old_label").alias("label"),
    )
    rest = in_use.select("id").distinct().join(rows.select("id"), "id", "left_anti")
    rows = rows.union(rest.select(F.lit(2**30).alias("a"), F.lit(0).alias("b"), "id", F.col("id").alias("label")))
    return rows.select((F.row_number().over(Window.orderBy("a", "b", "id")) - 1).alias("ord"), "id", "label")
