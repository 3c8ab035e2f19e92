"""Change capture: what a patch of cases stamps and logs, key assignment, bulk changes and settings' remaps.

A patch is a row with the id of a case and the patched columns; null leaves a column as it is. Old and new are joined
on the id, so any number of cases is patched at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklight.model import Context, is_terminal
from tracklight.operators.common import checkpoint, numbered

#: Fields whose changes are logged, in the order of the entries.
LOGGED = ("status", "severity", "priority", "verdict", "assignees", "due", "bucket")
ENTRY = "array<struct<at: string, field: string, `from`: string, `to`: string>>"


def _old_new(cases: DataFrame, patches: DataFrame) -> DataFrame:
    return cases.alias("o").join(patches.alias("p"), F.col("o.id") == F.col("p.id"))


def _flat(value: Column, is_list: bool) -> Column:
    return F.array_join(value, ", ") if is_list else value.cast("string")


def _entries(cases: DataFrame, patches: DataFrame) -> Column:
    """array of struct(field, from, to) of a joined row of a case (o) and its patch (p)."""
    types = dict(cases.dtypes)
    parts = []
    for field in (f for f in LOGGED if f in patches.columns):
        old, new = (_flat(F.col(f"{side}.{field}"), types[field].startswith("array")) for side in "op")
        changed = F.col(f"p.{field}").isNotNull() & ~old.eqNullSafe(new)
        entry = F.struct(F.lit(field).alias("field"), F.coalesce(old, F.lit("")).alias("from"), F.coalesce(new, F.lit("")).alias("to"))
        parts.append(F.when(changed, F.array(entry)))
    if "iocs" in patches.columns:
        values = {s: F.array_distinct(F.transform(F.col(f"{s}.iocs"), lambda i: i["value"])) for s in "op"}
        name, blank = F.lit("iocs").alias("field"), F.lit("")
        added = lambda v: F.struct(name, blank.alias("from"), v.alias("to"))
        removed = lambda v: F.struct(name, v.alias("from"), blank.alias("to"))
        parts.append(F.transform(F.array_except(values["p"], values["o"]), added))
        parts.append(F.transform(F.array_except(values["o"], values["p"]), removed))
    empty = F.expr("slice(array(named_struct('field', '', 'from', '', 'to', '')), 1, 0)")
    return F.concat(*(F.coalesce(p, empty) for p in parts)) if parts else empty


def activity_diff(cases: DataFrame, patches: DataFrame, at: str) -> DataFrame:
    """id, at, field, from, to: an entry for each logged field that a patch changes, and for each indicator it adds or removes.

    Lists are compared as joined text. Indicators are known by their value alone.
    """
    rows = _old_new(cases, patches).select("o.id", F.posexplode(_entries(cases, patches)).alias("pos", "e"))
    return rows.select("id", "pos", F.lit(at).alias("at"), "e.field", "e.from", "e.to")


def _completion(patches: DataFrame, ctx: Context) -> Column:
    """What a joined row's patch makes of the day of completion; null where it stamps nothing."""
    counts = F.col("p.status").isNotNull()
    if "completed" in patches.columns:
        counts &= F.col("p.completed").isNull() | F.col("p.completed").eqNullSafe(F.col("o.completed"))
    was, now = is_terminal(ctx, F.col("o.status")), is_terminal(ctx, F.col("p.status"))
    return F.when(counts & now & ~was, ctx.today).when(counts & was & ~now, "")


def completion_stamp(cases: DataFrame, patches: DataFrame, ctx: Context) -> DataFrame:
    """id, completed: today's date where a patch ends a case, '' where it opens it again; other cases aren't listed.

    A patch that brings another date of completion keeps it.
    """
    return _old_new(cases, patches).select("o.id", _completion(patches, ctx).alias("completed")).where("completed is not null")


def _lifecycle(patches: DataFrame, ctx: Context, at: str) -> dict[str, Column]:
    """What a joined row's patch stamps as responded_at and resolved_at; null where nothing."""
    issue_type = F.col("o.issue_type")
    if "issue_type" in patches.columns:
        issue_type = F.coalesce("p.issue_type", "o.issue_type")
    counts = (issue_type == "incident") & (F.col("p.status") != F.col("o.status"))

    def stamp(column: str, when: Column) -> Column:
        by_hand = F.lit(False)
        if column in patches.columns:
            by_hand = F.col(f"p.{column}").isNotNull() & ~F.col(f"p.{column}").eqNullSafe(F.col(f"o.{column}"))
        unset = F.coalesce(F.col(f"o.{column}"), F.lit("")) == ""
        return F.when(counts & when & unset & ~by_hand, at)

    return {"responded_at": stamp("responded_at", F.lit(True)), "resolved_at": stamp("resolved_at", is_terminal(ctx, F.col("p.status")))}


def lifecycle_stamp(cases: DataFrame, patches: DataFrame, ctx: Context, at: str) -> DataFrame:
    """id, responded_at, resolved_at: what a change of an incident's status stamps; null where nothing is stamped.

    The first change is the response, one to a terminal status the resolution. A patch's own instant wins.
    """
    rows = _old_new(cases, patches).select("o.id", *(x.alias(c) for c, x in _lifecycle(patches, ctx, at).items()))
    return rows.where("responded_at is not null or resolved_at is not null")


def apply_patches(cases: DataFrame, patches: DataFrame, ctx: Context, at: str) -> DataFrame:
    """The cases with patches, stamps and log entries applied, by one join. Each case has one patch at most."""
    value = {c: F.coalesce(f"p.{c}", f"o.{c}") for c in patches.columns if c != "id" and c in cases.columns}
    stamps = {}
    if "status" in patches.columns:
        stamps = {"completed": _completion(patches, ctx)} | (_lifecycle(patches, ctx, at) if "issue_type" in cases.columns else {})
    for c, stamp in stamps.items():
        if c in cases.columns:
            value[c] = F.coalesce(stamp, value.get(c, F.col(f"o.{c}")))
    if "activity" in cases.columns:
        log = F.transform(_entries(cases, patches), lambda e: F.struct(F.lit(at).alias("at"), e["field"].alias("field"), e["from"].alias("from"), e["to"].alias("to")))
        value["activity"] = F.concat(value.get("activity", F.col("o.activity")), F.when(F.col("p.id").isNotNull(), log).otherwise(F.array().cast(ENTRY))).cast(ENTRY)
    rows = cases.alias("o").join(patches.alias("p"), F.col("o.id") == F.col("p.id"), "left")
    return rows.select(*(value.get(c, F.col(f"o.{c}")).alias(c) for c in cases.columns))


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, change (new, removed or changed) of two states of the same cases; equal ones aren't listed."""
    both = [c for c in old.columns if c != "id" and c in new.columns]
    o, n = (df.select("id", F.struct(*both).alias(name)) for df, name in ((old, "o"), (new, "n")))
    change = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return o.join(n, "id", "full").select("id", change.alias("change")).where("change is not null")


# Keys.


def assign_keys(cases: DataFrame, prefix: str, next_seq: int = 1) -> DataFrame:
    """id, key: keys for the cases without one, in order of creation, then of the tree."""
    order = ["created_at", *(["tree_pos"] if "tree_pos" in cases.columns else []), "id"]
    rows = numbered(cases.where(F.col("key") == "").select("project_id", *order), ["project_id"], order, "_n")
    return rows.select("id", F.concat(F.lit(prefix + "-"), (F.col("_n") + next_seq - 1).cast("string")).alias("key"))


EMBEDDED = r"^([A-Z][A-Z0-9]+)-(\d+):?\s*"


def embedded_key(title: Column | str) -> Column:
    """struct(prefix, seq, title) of a title that begins with a key; null if it doesn't. A title of a key alone stays."""
    title = F.col(title) if isinstance(title, str) else title
    rest = F.regexp_replace(title, EMBEDDED, "")
    seq = F.regexp_extract(title, EMBEDDED, 2).try_cast("long")
    found = F.struct(F.regexp_extract(title, EMBEDDED, 1).alias("prefix"), seq.alias("seq"), F.when(rest == "", title).otherwise(rest).alias("title"))
    return F.when(title.rlike(EMBEDDED), found)


def adopt_keys(cases: DataFrame, fallback: str = "", stored: DataFrame | None = None) -> DataFrame:
    """id, key, title, how (adopted or assigned) of each case that gets a key, for each project.

    cases has project_id, id, key, title, created_at and tree_pos. The prefix is the one that `stored` (project_id, key_prefix; a row
    for a project) has, '' being none; else that of most titles, the first of equals, else `fallback`; projects without one get nothing. A key in a title is adopted, whatever its prefix, if no other case
    has its number; first come, first served. The others get new numbers above all used ones, oldest first.
    """
    rows = cases.select("project_id", "id", "key", "title", "created_at", "tree_pos", embedded_key("title").alias("e"))
    votes = rows.where("e is not null").groupBy("project_id", "e.prefix").agg(F.count("*").alias("n"), F.min("tree_pos").alias("at"))
    best = votes.groupBy("project_id").agg(F.max_by("prefix", F.struct("n", -F.col("at"))).alias("prefix"))
    if stored is not None:
        kept = stored.where("key_prefix <> ''").groupBy("project_id").agg(F.max("key_prefix").alias("_kept"))
        best = best.join(kept, "project_id", "full").select("project_id", F.coalesce("_kept", "prefix").alias("prefix"))
    rows = rows.join(best, "project_id", "left").withColumn("prefix", F.coalesce("prefix", F.lit(fallback.upper())))
    rows = rows.where(F.col("prefix").rlike("^[A-Z][A-Z0-9]*$"))
    own = F.when(F.col("key").startswith(F.concat("prefix", F.lit("-"))), F.regexp_extract("key", r"-(\d+)$", 1).try_cast("long"))
    used = rows.where(F.col("key") != "").select("project_id", own.alias("seq")).where("seq is not null").distinct()
    asking = rows.where("key = '' and e is not null").join(
        used.select(F.col("project_id").alias("_p"), F.col("seq").alias("_s")),
        (F.col("project_id") == F.col("_p")) & (F.col("e.seq") == F.col("_s")),
        "left_anti",
    )
    first = F.row_number().over(Window.partitionBy("project_id", "e.seq").orderBy("tree_pos", "id"))
    adopted = asking.withColumn("_n", first).where("_n = 1")
    adopted = adopted.select("project_id", "id", "prefix", "e.seq", F.col("e.title").alias("title"))
    top = used.union(adopted.select("project_id", "seq")).groupBy("project_id").agg(F.max("seq").alias("top"))
    rest = rows.where("key = ''").join(adopted.select("id"), "id", "left_anti").select("project_id", "id", "prefix", "title", "created_at", "tree_pos")
    rest = numbered(rest, ["project_id"], ["created_at", "tree_pos", "id"], "_place").join(top, "project_id", "left")
    fresh = F.coalesce("top", F.lit(0)) + F.col("_place")
    assigned = rest.select("id", F.concat("prefix", F.lit("-"), fresh.cast("string")).alias("key"), "title", F.lit("assigned").alias("how"))
    given = adopted.select("id", F.concat("prefix", F.lit("-"), F.col("seq").cast("string")).alias("key"), "title", F.lit("adopted").alias("how"))
    return given.union(assigned)


# Bulk changes, and changes that settings make.


def update(cases: DataFrame, chosen: Column, change: Callable[[DataFrame], DataFrame] | dict[str, Column]) -> DataFrame:
    """Columns, or a function of a DataFrame, applied to the chosen cases."""
    chosen = F.coalesce(chosen, F.lit(False))
    if callable(change):
        return cases.where(~chosen).unionByName(change(cases.where(chosen)))
    return cases.withColumns({c: F.when(chosen, x).otherwise(F.col(c)) for c, x in change.items()})


def add_value(column: str, value: str) -> Column:
    """A list with a value at its end, if it isn't there."""
    return F.when(F.array_contains(column, value), F.col(column)).otherwise(F.array_append(column, F.lit(value)))


def remap_deleted(
    cases: DataFrame, column: str, deleted: str, ctx: Context, issue_types: tuple = (), overriding: DataFrame | None = None, at: str = ""
) -> DataFrame:
    """Cases whose id was deleted from a catalog, set to what takes its place; with `at`, stamped and logged as any change is.

    A status becomes the catalog's first; an issue type `task`, or the first if there is none; severity and verdict ''. Nothing
    changes where a catalog has no status left.
    Projects in `overriding` (project_id), which define the id themselves, are left alone.
    """
    if column == "status":
        value = next((s[0] for s in ctx.statuses if s[0] != deleted), None)
        if value is None:
            return cases
    elif column == "issue_type":
        left = [t[0] for t in issue_types if t[0] != deleted]
        value = "task" if "task" in left or not left else left[0]
    else:
        value = ""
    if at:
        chosen = cases.where(F.col(column) == deleted)
        if overriding is not None:
            chosen = chosen.join(overriding.select("project_id").distinct(), "project_id", "left_anti")
        return apply_patches(cases, chosen.select("id", F.lit(value).alias(column)), ctx, at)
    if overriding is None:
        return update(cases, F.col(column) == deleted, {column: F.lit(value)})
    marked = cases.join(overriding.select(F.col("project_id").alias("_own")).distinct(), F.col("project_id") == F.col("_own"), "left")
    return update(marked, (F.col(column) == deleted) & F.col("_own").isNull(), {column: F.lit(value)}).drop("_own")


def coerce_type(cases: DataFrame) -> DataFrame:
    """Milestones have no start, progress or parent; a subtask without a parent is a task."""
    milestone = F.col("type") == "milestone"
    return cases.withColumns(
        {
            "start": F.when(milestone, "").otherwise(F.col("start")),
            "progress": F.when(milestone, 0.0).otherwise(F.col("progress")),
            "parent_id": F.when(milestone, "").otherwise(F.col("parent_id")),
            "type": F.when((F.col("type") == "subtask") & (F.col("parent_id") == ""), "task").otherwise(F.col("type")),
        }
    )


#: From so many cases below it on, a folder is looked up in a broadcast table: a shuffle would give all of them to one task.
CROWDED = 50_000


def archive(cases: DataFrame, ids: DataFrame, restore: bool = False) -> DataFrame:
    """Cases (ids has id) moved into their folder's Archive, or out of it; their paths and archived follow.

    A case's own folder, of its file's name, moves with it, and so the files in it do: they stay what they are, at their new paths.
    Of the crowded folders there is one at most for each CROWDED cases and level, so what is broadcast stays small.
    """
    moved = cases.join(ids.select(F.col("id").alias("_a")).distinct(), F.col("id") == F.col("_a"), "left")
    path = F.col("file_path")
    inside = F.regexp_replace(path, r"^(.*/)?([^/]+)$", "$1Archive/$2")
    new = F.regexp_replace(path, r"(^|/)Archive/([^/]+)$", "$1$2") if restore else F.when(path.rlike(r"(^|/)Archive/[^/]+$"), path).otherwise(inside)
    chosen = F.col("_a").isNotNull()
    folder = lambda x: F.regexp_replace(x, r"\.md$", "")
    folders = moved.where(chosen).select(folder(path).alias("_from"), folder(new).alias("_to")).where("_from <> _to").distinct()
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))
    below = moved.where(~chosen).select("id", F.explode(above).alias("_from"))
    crowded = checkpoint(below.groupBy("_from").count().where(F.col("count") > CROWDED).select("_from"))
    carried = below.join(F.broadcast(crowded), "_from", "left_anti").join(folders, "_from")
    moving = checkpoint(folders.join(F.broadcast(crowded), "_from", "left_semi"))
    if not moving.isEmpty():
        carried = carried.union(below.join(F.broadcast(moving), "_from").select(carried.columns))
    carried = carried.groupBy(F.col("id").alias("_c")).agg(F.max_by(F.struct("_from", "_to"), F.length("_from")).alias("_with"))
    out = moved.join(carried, F.col("id") == F.col("_c"), "left")
    follows = F.concat(F.col("_with._to"), F.substring(path, F.length("_with._from") + 1, F.length(path)))
    out = out.withColumn("file_path", F.when(chosen, new).when(F.col("_c").isNotNull(), follows).otherwise(path))
    return out.withColumn("archived", F.when(chosen, F.lit(not restore)).otherwise(F.col("archived"))).drop("_a", "_c", "_with")


def dirty(marks: DataFrame) -> DataFrame:
    """id, kind: of the marks of a case the heavier stays, `full` over `fm`."""
    return marks.groupBy("id").agg(F.max_by("kind", F.when(F.col("kind") == "full", 1).otherwise(0)).alias("kind"))


def recents(opened: DataFrame, cases: DataFrame, most: int = 15) -> DataFrame:
    """id, last_ms, pos: the `most` cases opened last, those that are gone left out."""
    last = opened.groupBy("id").agg(F.max("at_ms").alias("last_ms"))
    kept = last.join(cases.select("id"), "id", "left_semi").orderBy(F.desc("last_ms"), "id").limit(most)
    return kept.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("last_ms"), "id")))  # of `most` rows


def prune_settings(settings: DataFrame, paths: DataFrame) -> DataFrame:
    """Settings whose path is still there."""
    return settings.join(paths, "path", "left_semi")


def free_name(taken: DataFrame, name: str) -> DataFrame:
    """One row, name: the first of `name (copy)`, `name (copy 2)`, ... that isn't taken, however many are.

    It is the first or follows one that is taken, so only those are looked at.
    """
    start = F.length(F.lit(f"{name} (copy"))
    rest = F.when(F.col("name").startswith(f"{name} (copy"), F.substring("name", start + 1, 30))
    number = F.when(rest == ")", F.lit(1)).when(rest.rlike(r"^ [1-9]\d{0,17}\)$"), F.regexp_extract(rest, r"\d+", 0).cast("long"))
    used = taken.select(number.cast("long").alias("n")).where((F.col("n") == 1) | (F.col("n") > 1) & (rest != " 1)")).distinct()
    first = taken.sparkSession.range(1, 2).select(F.col("id").alias("n"))
    free = first.union(used.select((F.col("n") + 1).alias("n"))).join(used, "n", "left_anti").agg(F.min("n").alias("n"))
    return free.select(F.when(F.col("n") == 1, f"{name} (copy)").otherwise(F.concat(F.lit(f"{name} (copy "), F.col("n").cast("string"), F.lit(")"))).alias("name"))


#: Templates of new incidents by id, name, columns and the items of the body's checklist.
TEMPLATES = (
    (
        "phishing",
        "Phishing",
        {"severity": "sev3", "priority": "high", "tags": ["phishing"]},
        (
            "Preserve the original email (headers included)",
            "Extract and record IOCs (sender, URLs, attachments)",
            "Check who else received it / clicked",
            "Block sender / URLs where confirmed malicious",
            "Reset credentials for anyone who submitted them",
            "Record verdict and close",
        ),
    ),
    (
        "malware",
        "Malware",
        {"severity": "sev2", "priority": "high", "tags": ["malware"]},
        (
            "Isolate the affected host",
            "Capture hashes and record IOCs",
            "Identify the malware family and delivery vector",
            "Scope lateral movement / other detections",
            "Remediate and restore",
            "Record verdict and close",
        ),
    ),
    (
        "credential-compromise",
        "Credential compromise",
        {"severity": "sev2", "priority": "critical", "tags": ["credentials"]},
        (
            "Disable / reset the affected account(s)",
            "Revoke active sessions and tokens",
            "Review sign-in and audit logs for misuse",
            "Identify the exposure vector",
            "Check for persistence (forwarding rules, MFA changes)",
            "Record verdict and close",
        ),
    ),
)


def template_body(items: tuple[str, ...]) -> str:
    """A body with an empty summary and a checklist."""
    return "\n".join(["## Summary", "", "", "## Checklist", *(f"- [ ] {x}" for x in items)])


def from_template(blank: DataFrame, template: str, now: str) -> DataFrame:
    """Blank cases made incidents of a template, with its body, detected now."""
    values, items = next((v, x) for i, _, v, x in TEMPLATES if i == template)
    values = values | {"description": template_body(items)}
    columns = {c: F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x) for c, x in values.items()}
    return blank.withColumns(columns | {"issue_type": F.lit("incident"), "detected_at": F.lit(now)})
