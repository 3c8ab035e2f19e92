"""Forests of cases: a case names its parent ('' at a root) and its place among its siblings, ord.

What hangs below a missing parent or in a cycle is in no tree and in no result, except where said.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklight.functions.sla import sla_sort, sla_state
from tracklight.model import Context, is_terminal, rank, status_rank
from tracklight.operators.common import checkpoint, numbered, recursive

#: Deepest tree that is walked.
LEVELS = 1000


def _walk(cases: DataFrame, columns: dict[str, tuple[str, str]], roots: str = "c.parent_id = ''", below: str = "true") -> DataFrame:
    """id and the columns for each case that is reached from the roots; (root, below) expressions over c and w."""
    names = ", ".join(columns)
    first = ", ".join(f"{x} AS {name}" for name, (x, _) in columns.items())
    then = ", ".join(f"{x} AS {name}" for name, (_, x) in columns.items())
    return recursive(
        cases,
        f"""WITH RECURSIVE w(id, {names}) MAX RECURSION LEVEL {LEVELS} AS (
          SELECT c.id, {first} FROM {{c}} c WHERE {roots}
          UNION ALL
          SELECT c.id, {then} FROM w JOIN {{c}} c ON c.parent_id = w.id WHERE {below})
        SELECT * FROM w""",
    )


PATH = ("lpad(cast(c.ord AS string), 10, '0')", "concat(w.path, '/', lpad(cast(c.ord AS string), 10, '0'))")
DEPTH = ("0", "w.depth + 1")


def flatten(cases: DataFrame) -> DataFrame:
    """id, depth, path, visible: path sorts as a depth-first walk; a case below a collapsed one isn't visible."""
    slim = cases.select("id", "parent_id", "ord", "collapsed")
    columns = {
        "depth": DEPTH,
        "path": PATH,
        "visible": ("true", "w.visible AND NOT w.shut"),
        "shut": ("c.collapsed", "c.collapsed"),
    }
    return _walk(slim, columns).drop("shut")


def filter_strict(cases: DataFrame, keep: Column) -> DataFrame:
    """id, depth, path of the cases that are kept, as are all above them."""
    return _walk(cases.where(keep).select("id", "parent_id", "ord"), {"depth": DEPTH, "path": PATH})


def prune_archived(cases: DataFrame) -> DataFrame:
    """Without archived cases and what is below them."""
    return filter_strict(cases, ~F.coalesce(F.col("archived"), F.lit(False)))


def filter_promote(cases: DataFrame, keep: Column) -> DataFrame:
    """id, parent_id, path of the kept cases: each hangs below the nearest kept case above it, in the order of the walk."""
    slim = cases.select("id", "parent_id", "ord", F.coalesce(keep, F.lit(False)).alias("kept"))
    columns = {
        "path": PATH,
        "above": ("''", "CASE WHEN w.kept THEN w.id ELSE w.above END"),
        "kept": ("c.kept", "c.kept"),
    }
    return _walk(slim, columns).where("kept").select("id", F.col("above").alias("parent_id"), "path")


def nearest_epic(cases: DataFrame) -> DataFrame:
    """id, epic_id: the nearest epic above each case, itself not counted; '' if there is none."""
    slim = cases.select("id", "parent_id", (F.col("issue_type") == "epic").alias("epic"))
    columns = {
        "epic_id": ("''", "CASE WHEN w.epic THEN w.id ELSE w.epic_id END"),
        "epic": ("c.epic", "c.epic"),
    }
    return _walk(slim, columns).select("id", "epic_id")


def subtree(cases: DataFrame, *ids: str) -> DataFrame:
    """id, depth of the cases with these ids and all below them; depth counts from the nearest named case. A cycle is walked once.

    A level is a join; what has been seen isn't walked again.
    """
    links = cases.select("id", "parent_id")
    seen = level = checkpoint(links.where(F.col("id").isin(*ids)).select("id", F.lit(0).alias("depth")).distinct())
    depth = 0
    while not level.isEmpty():
        depth += 1
        below = links.join(level.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id").distinct()
        level = checkpoint(below.join(seen, "id", "left_anti").select("id", F.lit(depth).alias("depth")))
        seen = seen.union(level)
    return seen


def parent_candidates(cases: DataFrame, *ids: str) -> DataFrame:
    """Cases that the named ones can hang below: not they themselves and nothing below them."""
    return cases.join(subtree(cases, *ids).select("id"), "id", "left_anti")


def with_parent(cases: DataFrame) -> DataFrame:
    """`cases` with parent_key and parent_title; '' at a root."""
    parents = cases.select(F.col("id").alias("_p"), F.col("key").alias("parent_key"), F.col("title").alias("parent_title"))
    out = cases.join(parents, F.col("parent_id") == F.col("_p"), "left").drop("_p")
    return out.fillna("", ["parent_key", "parent_title"])


def subtask_progress(cases: DataFrame, ctx: Context) -> DataFrame:
    """id, total, done (long) for each case with direct children."""
    children = cases.where("parent_id <> ''").groupBy(F.col("parent_id").alias("id"))
    return children.agg(F.count("*").alias("total"), F.count_if(is_terminal(ctx)).alias("done"))


def _text(value: Column) -> Column:
    return F.collate(value, "UNICODE")


def sort_columns(key: str, ctx: Context, descending: bool = False) -> list[Column]:
    """Sort keys of a case list; an unknown key sorts nothing.

    Keys: title, status, severity, due (unset last, so first when descending), assignees (the first one),
    progress, sla (closest to its breach first, then cases without a clock, then those that are over).
    """
    return [k.desc() if descending else k.asc() for k in _keys(key, ctx)]


def _keys(key: str, ctx: Context) -> list[Column]:
    return {
        "title": lambda: [_text(F.col("title"))],
        "status": lambda: [status_rank(ctx)],
        "severity": lambda: [rank(ctx.severities, F.col("severity"))],
        "due": lambda: [F.when(F.coalesce("due", F.lit("")) == "", "zzz").otherwise(F.col("due"))],
        "assignees": lambda: [_text(F.coalesce(F.get("assignees", F.lit(0)), F.lit("")))],
        "progress": lambda: [F.col("progress")],
        "sla": lambda: sla_sort(ctx, sla_state(ctx), is_terminal(ctx)),
    }.get(key, list)()


def sorted_rows(
    cases: DataFrame, key: str, ctx: Context, keep: Column | None = None, descending: bool = False, tie: str = "ord"
) -> DataFrame:
    """id, depth, path: siblings sorted, then walked depth-first.

    With a filter, a kept case whose parent isn't kept stands at the root, and collapsed cases are open;
    without one, such cases and what is below a collapsed case aren't listed. Ties keep the siblings' order.
    """
    kept = cases if keep is None else cases.where(keep)
    if keep is not None:
        ids = kept.select(F.col("id").alias("_p"))
        kept = kept.join(ids, F.col("parent_id") == F.col("_p"), "left")
        kept = kept.withColumn("parent_id", F.when(F.col("_p").isNull(), "").otherwise(F.col("parent_id"))).drop("_p")
    keys = _keys(key, ctx)
    slim = kept.select("id", "parent_id", F.coalesce("collapsed", F.lit(False)).alias("collapsed"), F.col(tie).alias("_tie"), *(k.alias(f"_k{i}") for i, k in enumerate(keys)))
    order = [F.col(f"_k{i}").desc() if descending else F.col(f"_k{i}").asc() for i in range(len(keys))]
    slim = numbered(slim, ["parent_id"], [*order, "_tie", "id"], "ord").select("id", "parent_id", "ord", "collapsed")
    columns = {"depth": DEPTH, "path": PATH, "shut": ("c.collapsed", "c.collapsed")}
    below = "NOT w.shut" if keep is None else "true"
    return _walk(slim, columns, below=below).drop("shut")


def window_rows(rows: DataFrame, first: int, count: int, overscan: int = 8) -> DataFrame:
    """The rows of a table's window, with `overscan` more on either side, in the order of the walk."""
    start = max(0, first - overscan)
    return rows.orderBy("path").offset(start).limit(first - start + count + overscan)


# Changes of a forest. Each gives the new cases.


def insert(cases: DataFrame, new: DataFrame, parent_id: str = "") -> DataFrame:
    """`new` cases as last children of a parent; at the root if there is no such parent."""
    parent = cases.where(F.col("id") == parent_id).select("id")
    siblings = cases.select("parent_id", "ord")
    spot = F.broadcast(parent.agg(F.coalesce(F.max("id"), F.lit("")).alias("_p")))
    last = siblings.join(spot, F.col("parent_id") == F.col("_p")).agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("_n"))
    placed = new.crossJoin(spot).crossJoin(F.broadcast(last))  # both of one row
    order = F.row_number().over(Window.partitionBy("_p").orderBy("ord", "id"))
    placed = placed.withColumn("ord", (F.col("_n") + order).cast("int")).withColumn("parent_id", F.col("_p"))
    return cases.unionByName(placed.drop("_p", "_n"))


def delete(cases: DataFrame, *ids: str) -> DataFrame:
    """Without the named cases and all below them."""
    return parent_candidates(cases, *ids)


def move(cases: DataFrame, case_id: str, parent_id: str) -> DataFrame:
    """With a case as last child of another; unchanged if that is the case itself or below it."""
    below = subtree(cases, case_id)
    allowed = below.where(F.col("id") == parent_id).count() == 0
    if not allowed:
        return cases
    return insert(cases.where(F.col("id") != case_id), cases.where(F.col("id") == case_id), parent_id)


def reorder(cases: DataFrame, case_id: str, before_id: str) -> DataFrame:
    """With a case right before a sibling; unchanged if the two aren't siblings."""
    pair = cases.where(F.col("id").isin(case_id, before_id)).select("parent_id").collect()
    if len(pair) != 2 or pair[0] != pair[1]:
        return cases
    here = F.col("parent_id") == pair[0].parent_id
    spot = F.max(F.when(F.col("id") == before_id, F.col("ord"))).over(Window.partitionBy("parent_id"))
    siblings = cases.where(here).withColumn("_s", F.when(F.col("id") == case_id, spot - 0.5).otherwise(F.col("ord")))
    order = F.row_number().over(Window.partitionBy("parent_id").orderBy("_s", "id")) - 1
    return cases.where(~here).unionByName(siblings.withColumn("ord", order.cast("int")).drop("_s"))


def clone(cases: DataFrame, case_id: str, new_id, now: str) -> DataFrame:
    """The copy of a subtree: new ids by `new_id` (a column function of the old), open, with no file, key, activity, comments, verdict or lifecycle.

    Parents and dependencies within the subtree point to the copies, other dependencies and the day of completion stay.
    """
    inside = subtree(cases, case_id).select("id")
    out = cases.join(inside, "id", "left_semi")
    inner = lambda name: F.broadcast(inside.select(F.col("id").alias(name)))  # noqa: E731  # one subtree, as its copy is one request
    if "dependencies" in cases.columns:
        each = out.select("id", F.posexplode("dependencies").alias("_at", "_d")).join(inner("_in"), F.col("_d") == F.col("_in"), "left")
        each = each.withColumn("_d", F.when(F.col("_in").isNotNull(), new_id(F.col("_d"))).otherwise(F.col("_d")))
        lists = each.groupBy(F.col("id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("_at", "_d"))).getField("_d").alias("_deps"))
        out = out.join(lists, F.col("id") == F.col("_id"), "left").withColumn("dependencies", F.coalesce("_deps", "dependencies"))
    out = out.join(inner("_up"), F.col("parent_id") == F.col("_up"), "left")
    out = out.withColumn("parent_id", F.when(F.col("_up").isNotNull(), new_id(F.col("parent_id"))).otherwise(F.col("parent_id")))
    out = out.withColumn("id", new_id(F.col("id")))
    blank = {c: F.lit("") for c in ("key", "verdict", "detected_at", "responded_at", "contained_at", "resolved_at", "file_path")}
    blank |= {"created_at": F.lit(now), "updated_at": F.lit(now), "collapsed": F.lit(False)}
    blank |= {c: F.expr(f"slice({c}, 1, 0)") for c in ("activity", "comments")}
    return out.withColumns({c: x for c, x in blank.items() if c in cases.columns}).select(cases.columns)


def overlay_collapsed(cases: DataFrame, states: DataFrame) -> DataFrame:
    """`cases` with collapsed as the states say: project_id, ids (the collapsed cases), a row at most for a project.

    In a project that has a row, all cases it doesn't name are open; in any other, collapsed stays.
    """
    recorded = states.select("project_id", F.lit(True).alias("_recorded"))
    shut = states.select("project_id", F.explode("ids").alias("id"), F.lit(True).alias("_shut")).distinct()
    out = cases.join(recorded, "project_id", "left").join(shut, ["project_id", "id"], "left")
    out = out.withColumn("collapsed", F.when(F.col("_recorded"), F.coalesce("_shut", F.lit(False))).otherwise(F.col("collapsed")))
    return out.select(cases.columns)


def is_nested_card(order: list[str]) -> Column:
    """Whether the card above in the same lane and status is the case's parent or a subtask of the same parent."""
    w = Window.partitionBy("lane", "status").orderBy(*order)
    up = [F.lag(c).over(w) for c in ("id", "parent_id", "type")]
    beside = (up[1] == F.col("parent_id")) & (up[2] == "subtask")
    tests = [F.col("type") == "subtask", F.col("parent_id") != "", (up[0] == F.col("parent_id")) | beside]
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))
