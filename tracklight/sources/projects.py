"""Project notes as a source and sink: settings, saved views, and the cases that older projects hold in their own front matter.

As with cases, each field is given its default or dropped on its own. A project is a row; what it lists (settings,
views, its root cases) is as long as a person makes it, and its note is one file.
"""

from __future__ import annotations

import hashlib
import json
import math
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracklight.functions.text import sanitize_name, task_folder
from tracklight.model import CASE_SCHEMA, Context, is_terminal
from tracklight.operators import tree
from tracklight.operators.predicates import Filter
from tracklight.sources import vault

#: What a project has that doesn't say.
COLOR, ICON, ENTRY_COLOR = "#8b72be", "\U0001f4cb", "#8a94a0"
VIEWS = ("table", "gantt", "kanban", "backlog", "reports")
FILTER_LISTS = ("statuses", "priorities", "severities", "verdicts", "assignees", "tags")
SWITCHES = {"auto_schedule": "autoSchedule", "kanban_show_subtasks": "kanbanShowSubtasks", "kanban_show_description_preview": "kanbanShowDescriptionPreview"}

_LISTS = ", ".join(f"{x}: ARRAY<STRING>" for x in FILTER_LISTS)
VIEW = f"STRUCT<id: STRING, name: STRING, filter: STRUCT<text: STRING, {_LISTS}, due: STRING, show_archived: BOOLEAN>, sort_key: STRING, sort_dir: STRING, view_mode: STRING>"
_ENTRY = "id: STRING, label: STRING, color: STRING, icon: STRING"
CONFIG = f"""STRUCT<statuses: ARRAY<STRUCT<{_ENTRY}, complete: BOOLEAN, wip_limit: DOUBLE>>, priorities: ARRAY<STRUCT<{_ENTRY}>>,
issue_types: ARRAY<STRUCT<{_ENTRY}>>, default_view: STRING, {", ".join(f"{x}: BOOLEAN" for x in SWITCHES)}>"""
#: custom_fields is JSON text, as its entries' shape is the user's; task_ids is null where a note has none.
PROJECT_SCHEMA = f"""id STRING, title STRING, description STRING, color STRING, icon STRING, custom_fields STRING, team_members ARRAY<STRING>,
key_prefix STRING, next_key_seq LONG, created_at STRING, updated_at STRING, file_path STRING, task_ids ARRAY<STRING>,
saved_views ARRAY<{VIEW}>, config {CONFIG}"""


def _or(value: object, default: str) -> str:
    return value if isinstance(value, str) else default


def view_of(raw: dict) -> dict:
    """A saved view of its front matter."""
    chosen = raw.get("filter") if isinstance(raw.get("filter"), dict) else {}
    kept = {"text": _or(chosen.get("text"), "")} | {x: vault._texts(chosen.get(x)) for x in FILTER_LISTS}
    kept |= {"due": _or(chosen.get("dueDateFilter"), "any"), "show_archived": chosen.get("showArchived") is True}
    return {
        "id": _or(raw.get("id"), ""),
        "name": _or(raw.get("name"), "Untitled"),
        "filter": kept,
        "sort_key": _or(raw.get("sortKey"), "status"),
        "sort_dir": raw["sortDir"] if raw.get("sortDir") in ("asc", "desc") else "asc",
        "view_mode": raw.get("viewMode") if raw.get("viewMode") in VIEWS else None,
    }


def _entries(raw: object, status: bool = False) -> list[dict] | None:
    """A catalog's entries that have an id; null where there are none, so that the project inherits."""
    out = []
    for e in vault._dicts(raw):
        if not isinstance(e.get("id"), str) or not e["id"]:
            continue
        entry = {"id": e["id"], "label": _or(e.get("label"), e["id"]), "color": _or(e.get("color"), ENTRY_COLOR), "icon": _or(e.get("icon"), "")}
        if status:
            limit = vault._number(e.get("wipLimit"))
            entry |= {"complete": e.get("complete") is True, "wip_limit": limit if limit and limit > 0 else None}
        out.append(entry)
    return out or None


def config_of(raw: object) -> dict | None:
    """A project's own settings; null where it inherits them all."""
    if not isinstance(raw, dict):
        return None
    out = {"statuses": _entries(raw.get("statuses"), True), "priorities": _entries(raw.get("priorities")), "issue_types": _entries(raw.get("issueTypes"))}
    out["default_view"] = raw.get("defaultView") if raw.get("defaultView") in VIEWS else None
    out |= {x: raw[n] if isinstance(raw.get(n), bool) else None for x, n in SWITCHES.items()}
    return out if any(v is not None for v in out.values()) else None


def project_of(matter: dict, body: str, path: str) -> dict:
    """A project of a note's front matter; its file's name stands for an id or title it lacks."""
    name = posixpath.basename(path).removesuffix(".md")
    number = vault._number(matter.get("nextKeySeq"))
    return {
        "id": _or(matter.get("id"), name),
        "title": _or(matter.get("title"), name),
        "description": _or(matter.get("description"), body.strip()),
        "color": _or(matter.get("color"), COLOR),
        "icon": _or(matter.get("icon"), ICON),
        "custom_fields": json.dumps(matter["customFields"] if isinstance(matter.get("customFields"), list) else [], ensure_ascii=False),
        "team_members": vault._texts(matter.get("teamMembers")),
        "key_prefix": _or(matter.get("keyPrefix"), ""),
        "next_key_seq": math.floor(number) if number and number >= 1 else 1,
        "created_at": _or(matter.get("createdAt"), ""),
        "updated_at": _or(matter.get("updatedAt"), ""),
        "file_path": path,
        "task_ids": vault._texts(matter["taskIds"]) if isinstance(matter.get("taskIds"), list) else None,
        "saved_views": [view_of(v) for v in vault._dicts(matter.get("savedViews"))],
        "config": config_of(matter.get("config")),
    }


def embedded_cases(matter: dict, path: str) -> list[dict]:
    """The cases that an old project holds in its own front matter, each with its parent and its place; a case without an id gets one of its place."""
    if isinstance(matter.get("taskIds"), list):
        return []
    project, out = _or(matter.get("id"), posixpath.basename(path).removesuffix(".md")), []
    todo = [(x, "", i, (i,)) for i, x in enumerate(vault._dicts(matter.get("tasks")))]
    while todo:
        raw, parent, place, trail = todo.pop()
        case = vault.hydrate(raw, _or(raw.get("description"), ""), path)
        case |= {"project_id": project, "parent_id": parent, "ord": place, "collapsed": raw.get("collapsed") is True, "archived": raw.get("archived") is True, "file_path": ""}
        case["id"] = case["id"] or hashlib.sha256(f"{path}\n{trail}".encode()).hexdigest()[:12]
        out.append(case)
        todo += [(x, case["id"], i, (*trail, i)) for i, x in enumerate(vault._dicts(raw.get("subtasks")))]
    return out


def _parsed(files: DataFrame, schema: str, rows_of) -> DataFrame:
    shape = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(shape)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                matter, body = vault.split_front_matter(content or "")
                if matter and matter.get(vault.PROJECT_MARK) is True:
                    rows += rows_of(matter, body, path)
            for x in rows:
                if isinstance(x.get("custom_fields"), dict):
                    x["custom_fields"] = list(x["custom_fields"].items())
            yield from pa.Table.from_pylist(rows, schema=arrow).to_batches()

    return files.select("value", "path").mapInArrow(parse, shape)


def discover(files: DataFrame, base: str = "") -> DataFrame:
    """Files (value, path) that can be a project's note by their path, each path once; whether they are, their front matter says."""
    return files.where(vault.project_paths(F.col("path"), base)).dropDuplicates(["path"])


def parse_projects(files: DataFrame) -> DataFrame:
    """Projects (PROJECT_SCHEMA) of those files that are a project's note."""
    return _parsed(files, PROJECT_SCHEMA, lambda matter, body, path: [project_of(matter, body, path)])


def parse_embedded(files: DataFrame) -> DataFrame:
    """Cases of the projects that hold them in their own front matter."""
    return _parsed(files, CASE_SCHEMA, lambda matter, body, path: embedded_cases(matter, path))


def catalog(projects: DataFrame) -> DataFrame:
    """project_id, ord, id, label, complete: the statuses of the projects that have their own, for catalogs.resolve."""
    rows = projects.select(F.col("id").alias("project_id"), F.posexplode("config.statuses").alias("ord", "s"))
    return rows.select("project_id", "ord", "s.id", "s.label", "s.complete")


# The sink.


def _view_matter(v: dict) -> dict:
    f = v["filter"]
    chosen = {"text": f["text"]} | {x: f[x] for x in FILTER_LISTS} | {"dueDateFilter": f["due"], "showArchived": f["show_archived"]}
    out = {"id": v["id"], "name": v["name"], "filter": chosen, "sortKey": v["sort_key"], "sortDir": v["sort_dir"]}
    return out | ({"viewMode": v["view_mode"]} if v.get("view_mode") else {})


def _config_matter(config: dict | None) -> dict:
    """Front matter of a project's own settings: only what it sets."""
    names = {"statuses": "statuses", "priorities": "priorities", "issue_types": "issueTypes", "default_view": "defaultView"} | SWITCHES
    out = {names[x]: v for x, v in (config or {}).items() if v is not None and v != []}
    if "statuses" in out:
        out["statuses"] = [{"wipLimit" if k == "wip_limit" else k: x for k, x in s.items() if x is not None} for s in out["statuses"]]
    return out


def project_text(p: dict, roots: list[dict]) -> str:
    """A project's note: front matter, heading, description and the checklist of its root cases (id, title, file_path, done), each id once."""
    roots = list({r["id"]: r for r in reversed(roots)}.values())[::-1]
    matter = {
        vault.PROJECT_MARK: True, "id": p["id"], "title": p["title"], "description": p["description"], "color": p["color"], "icon": p["icon"],
        "taskIds": [r["id"] for r in roots], "customFields": json.loads(p["custom_fields"] or "[]"), "teamMembers": p["team_members"] or [],
        "savedViews": [_view_matter(v) for v in p["saved_views"] or []], "createdAt": p["created_at"], "updatedAt": p["updated_at"],
    }
    if p["key_prefix"]:
        matter |= {"keyPrefix": p["key_prefix"], "nextKeySeq": p["next_key_seq"]}
    if config := _config_matter(p["config"]):
        matter["config"] = config
    lines = ["---", *vault.yaml_lines(matter), "---", "", f"# {p['icon']} {p['title']}", ""]
    if p["description"]:
        lines += [p["description"], ""]
    if roots:
        name = lambda r: posixpath.basename(r["file_path"]).removesuffix(".md")
        lines += ["## Tasks", *(f"- [{'x' if r['done'] else ' '}] [[{name(r)}|{r['title']}]]" for r in roots if r["file_path"]), ""]
    return "\n".join(lines)


def render_projects(projects: DataFrame, cases: DataFrame, ctx: Context) -> DataFrame:
    """file_path, value: the note of each project (PROJECT_SCHEMA) with its root cases in their order."""
    root = F.struct("ord", "id", "title", "file_path", is_terminal(ctx).alias("done"))
    roots = cases.where("parent_id = ''").groupBy(F.col("project_id").alias("_p")).agg(F.array_sort(F.collect_list(root)).alias("_roots"))
    rows = projects.join(roots, F.col("id") == F.col("_p"), "left").drop("_p")
    rows = rows.select("file_path", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [project_text(p, p["_roots"] or []) for p in map(json.loads, batch.column(1).to_pylist())]
            yield pa.record_batch({"file_path": batch.column(0).cast(pa.string()), "value": pa.array(out, pa.string())})

    return rows.mapInArrow(render, "file_path STRING, value STRING")


def place_files(cases: DataFrame, projects: DataFrame) -> DataFrame:
    """`cases` with a file_path where they have none: their title in their project's folder of cases, with the id where two would be equal."""
    homes = projects.select(F.col("id").alias("_p"), task_folder("file_path").alias("_home"))
    out = cases.join(homes, F.col("project_id") == F.col("_p"), "left")
    name = sanitize_name("title")
    stem = F.concat(F.coalesce("_home", F.lit("Tasks")), F.when(F.col("archived"), "/Archive/").otherwise("/"), F.when(name == "", F.col("id")).otherwise(name))
    out = out.withColumn("_stem", F.when(F.coalesce("file_path", F.lit("")) == "", stem))
    shared = out.where("_stem is not null").groupBy(F.col("_stem").alias("_s")).count().where("count > 1")
    out = out.join(shared, F.col("_stem") == F.col("_s"), "left")
    own = F.when(F.col("_s").isNotNull(), F.concat("_stem", F.lit(" "), "id")).otherwise(F.col("_stem"))
    return out.withColumn("file_path", F.when(F.col("_stem").isNotNull(), F.concat(own, F.lit(".md"))).otherwise(F.col("file_path"))).select(cases.columns)


def migrate(files: DataFrame, ctx: Context) -> DataFrame:
    """file_path, value: notes of the projects among the files that still hold their cases themselves, and of each of those cases."""
    cases = parse_embedded(files)
    projects = parse_projects(files).where("task_ids is null")
    old = projects.join(cases.select(F.col("project_id").alias("id")).distinct(), "id", "left_semi").select(projects.columns)
    placed = place_files(cases, old)
    return render_projects(old, placed, ctx).union(vault.render_notes(placed, ctx.terminal))


# Saved views.


def _views(projects: DataFrame, project_id: str, change) -> DataFrame:
    views = F.coalesce("saved_views", F.array().cast(f"array<{VIEW}>"))
    return projects.withColumn("saved_views", F.when(F.col("id") == project_id, change(views)).otherwise(F.col("saved_views")))


def _literal(view: dict) -> Column:
    full = T._parse_datatype_string(f"v {VIEW}")["v"].dataType
    return F.from_json(F.lit(json.dumps(view)), full)


def make_view(view_id: str, name: str, chosen: Filter, sort_key: str = "status", descending: bool = False, mode: str | None = None) -> dict:
    """A view of the filter, sorting and mode that are in use."""
    kept = {"text": chosen.text} | {x: list(getattr(chosen, x)) for x in FILTER_LISTS} | {"due": chosen.due, "show_archived": chosen.show_archived}
    return {"id": view_id, "name": name, "filter": kept, "sort_key": sort_key, "sort_dir": "desc" if descending else "asc", "view_mode": mode}


def save_view(projects: DataFrame, project_id: str, view: dict) -> DataFrame:
    """With a view after the project's others."""
    return _views(projects, project_id, lambda views: F.array_append(views, _literal(view)))


def update_view(projects: DataFrame, project_id: str, view: dict) -> DataFrame:
    """With the view of this id as given, under the name it had; unchanged where there is none."""
    new = _literal(view)
    put = lambda v: F.when(v["id"] == view["id"], new.withField("name", v["name"])).otherwise(v)
    return _views(projects, project_id, lambda views: F.transform(views, put))


def delete_view(projects: DataFrame, project_id: str, view_id: str) -> DataFrame:
    return _views(projects, project_id, lambda views: F.filter(views, lambda v: v["id"] != view_id))


def select_view(projects: DataFrame, project_id: str, view_id: str | None) -> dict | None:
    """The view of an id, one project's row; with None the view that hides nothing, and None where there is no such view."""
    if view_id is None:
        return make_view("", "", Filter())
    found = projects.where(F.col("id") == project_id).select(F.get(F.filter("saved_views", lambda v: v["id"] == view_id), F.lit(0)).alias("v")).first()
    return found.v.asDict(recursive=True) if found and found.v else None


def filter_of(view: dict) -> Filter:
    f = view["filter"]
    return Filter(text=f["text"], due=f["due"], show_archived=f["show_archived"], **{x: tuple(f[x]) for x in FILTER_LISTS})


def apply_view(cases: DataFrame, view: dict, ctx: Context) -> DataFrame:
    """id, depth, path of the cases that a view shows, in its order."""
    chosen = filter_of(view)
    down = view["sort_dir"] == "desc"
    if chosen.active():
        return tree.sorted_rows(cases, view["sort_key"], ctx, keep=chosen.column(ctx), descending=down)
    return tree.sorted_rows(cases.where(chosen.column(ctx)), view["sort_key"], ctx, descending=down)
