"""Project notes, saved views, old projects, settings, templates and large groups."""

from pyspark.sql import functions as F
from test_query_language import CTX, make

from tracklight.functions import timeline
from tracklight.operators import capture, catalogs, settings
from tracklight.operators.common import numbered
from tracklight.operators.predicates import Filter
from tracklight.sources import projects, vault
from tracklight.sources.reader import Source, Vault

PROJECT = """---
pm-project: true
id: P
title: Proj
taskIds: [a]
nextKeySeq: 0
teamMembers: nobody
savedViews:
  - id: v
    filter: {text: "x", tags: [t], showArchived: yes}
    sortDir: sideways
    viewMode: nonsense
  - 3
config:
  statuses: [{id: open, complete: true, wipLimit: -1}, {label: nameless}, 4]
  priorities: []
  defaultView: nowhere
  autoSchedule: false
---
About it
"""
OLD = """---
pm-project: true
id: Q
title: Old
tasks:
  - {id: a, title: "One/two", status: done, description: "Text", subtasks: [{title: Sub, collapsed: true}, {id: c, title: Sub}]}
  - {id: d, title: "One-two"}
---
"""


def test_fields_of_a_project_note(spark):
    files = spark.createDataFrame([(PROJECT, "Cases/p.md"), ("---\npm-task: true\nid: x\n---\n", "x.md"), ("", "y.md"), (None, "z.md")], "value string, path string")
    (p,) = projects.parse_projects(files).collect()
    assert (p.id, p.title, p.description, p.color, p.next_key_seq, p.team_members, p.task_ids) == ("P", "Proj", "About it", projects.COLOR, 1, [], ["a"])
    (v,) = p.saved_views
    assert (v.id, v.name, v.sort_key, v.sort_dir, v.view_mode, v["filter"].text, v["filter"].tags, v["filter"].due) == ("v", "Untitled", "status", "asc", None, "x", ["t"], "any")
    assert [(s.id, s.label, s.complete, s.wip_limit) for s in p.config.statuses] == [("open", "open", True, None)]
    assert p.config.priorities is None and p.config.default_view is None and p.config.auto_schedule is False


def test_discovery(spark):
    paths = ["b/x.md", "b/Cases/y.md", "b/N/N.md", "b/N/M.md", "b/a/N/N.md", "c/x.md", "b/x.md", "b/x.txt"]
    files = spark.createDataFrame([("", p) for p in paths], "value string, path string")
    assert sorted(r.path for r in projects.discover(files, "b").collect()) == ["b/Cases/y.md", "b/N/N.md", "b/x.md"]


def test_old_projects_become_notes(spark, tmp_path):
    files = spark.createDataFrame([(OLD, "Cases/q.md"), (PROJECT, "Cases/p.md")], "value string, path string")
    held = {r.id: r for r in projects.parse_embedded(files).collect()}
    (sub,) = set(held) - {"a", "c", "d"}
    assert {i: (r.parent_id, r.ord, r.collapsed, r.project_id) for i, r in held.items()} == {"a": ("", 0, False, "Q"), sub: ("a", 0, True, "Q"), "c": ("a", 1, False, "Q"), "d": ("", 1, False, "Q")}
    notes = projects.migrate(files, CTX)
    folder = str(tmp_path / "v")
    assert vault.write_notes(notes, folder) == 5
    store = Vault(spark, folder)
    assert isinstance(store, Source)
    (q,) = store.projects().collect()
    assert (q.id, q.task_ids) == ("Q", ["a", "d"])
    text = (tmp_path / "v" / "Cases" / "q.md").read_text()
    assert "## Tasks\n- [x] [[One-two a|One/two]]\n- [ ] [[One-two d|One-two]]\n" in text
    back = {r.id: r for r in store.cases().collect()}
    assert {i: (r.parent_id, r.ord, r.title, r.status) for i, r in back.items()} == {i: (r.parent_id, r.ord, r.title, r.status) for i, r in held.items()}
    assert back["a"].description == "Text"
    assert projects.migrate(store.files(), CTX).count() == 0  # a second time there is nothing to do


def test_each_project_has_its_own_end(spark, tmp_path):
    folder = str(tmp_path / "v")
    case = "---\npm-task: true\nid: {}\nprojectId: {}\ntitle: T\nstatus: {}\n---\n"
    rows = [("Cases/p.md", PROJECT), ("T/a.md", case.format("a", "P", "open")), ("T/b.md", case.format("b", "Q", "open")), ("T/c.md", case.format("c", "P", "done"))]
    vault.write_notes(spark.createDataFrame(rows, "file_path string, value string"), folder)
    store = Vault(spark, folder)
    cases, ctx = store.context_for(store.cases(), CTX)
    from tracklight.model import is_terminal, status_rank

    got = {r.id: (r.t, r.n) for r in cases.select("id", is_terminal(ctx).alias("t"), status_rank(ctx).alias("n")).collect()}
    assert got == {"a": (True, 0), "b": (False, 6), "c": (True, 1)}
    patch = spark.createDataFrame([("b", "open"), ("a", "todo")], "id string, status string")
    new = {r.id: r.completed for r in capture.apply_patches(cases, patch, ctx, "2026-07-30T12:00:00Z").collect()}
    assert new == {"a": "", "b": "", "c": ""}
    catalogs_seen = catalogs.attach(cases.where("false"), spark.createDataFrame([], "project_id string, pos int, id string, label string, complete boolean"))
    assert catalogs_seen.count() == 0


def test_saved_views(spark):
    rows = make(spark, {"id": "a", "title": "x"}, {"id": "b", "title": "xy", "ord": 1}, {"id": "c", "title": "z", "parent_id": "b", "archived": True})
    made = spark.createDataFrame([("P",)], "id string").withColumn("saved_views", F.lit(None).cast(f"array<{projects.VIEW}>"))
    made = projects.save_view(made, "P", projects.make_view("1", "First", Filter(text="x"), "title", True, "table"))
    view = projects.select_view(made, "P", "1")
    assert projects.filter_of(view) == Filter(text="x") and [r.id for r in projects.apply_view(rows, view, CTX).orderBy("path").collect()] == ["b", "a"]
    made = projects.update_view(made, "P", projects.make_view("1", "ignored", Filter(text="z", show_archived=True)))
    view = projects.select_view(made, "P", "1")
    assert view["name"] == "First" and [r.id for r in projects.apply_view(rows, view, CTX).collect()] == ["c"]
    assert projects.select_view(made, "P", "2") is None and projects.select_view(projects.delete_view(made, "P", "1"), "P", "1") is None
    assert sorted(r.id for r in projects.apply_view(rows, projects.select_view(made, "P", None), CTX).collect()) == ["a", "b"]


def test_settings_migration():
    fresh, changed = settings.migrate(None)
    assert fresh == settings.defaults() and not changed
    saved = {
        "statuses": [{"id": "todo", "label": "T"}, {"id": "done", "label": "D"}, {"id": "x", "label": "X", "complete": True}],
        "priorities": [], "verdicts": [{"id": "pending", "label": "P"}], "ganttHideDone": True,
        "projectFilters": {"p": {"filter": {"statuses": []}}, "q": {"filter": {"statuses": ["done"], "verdicts": ["v"]}}},
    }
    new, changed = settings.migrate(saved)
    assert changed and [s["complete"] for s in new["statuses"]] == [False, True, True] and "complete" not in saved["statuses"][0]
    assert new["priorities"] == settings.defaults()["priorities"] and new["verdicts"] == settings.defaults()["verdicts"]
    assert new["projectFilters"]["p"]["filter"] == {"statuses": ["todo"], "severities": [], "verdicts": []}
    assert new["projectFilters"]["q"]["filter"] == {"statuses": ["done"], "severities": [], "verdicts": ["v"]}
    assert settings.context(new, "2026-07-30", 0).terminal == ("done", "x")


def test_large_groups_are_numbered(spark):
    rows = spark.range(3000).select((F.col("id") % 3 == 0).cast("string").alias("g"), ((F.col("id") * 7919) % 3000).alias("x"), "id")
    got = {r.id: r.n for r in numbered(rows, ["g"], [F.col("x").desc(), "id"], "n").collect()}
    want = {}
    for g in (True, False):
        for n, i in enumerate(sorted((i for i in range(3000) if (i % 3 == 0) == g), key=lambda i: -(i * 7919 % 3000)), 1):
            want[i] = n
    assert got == want
    assert numbered(rows.where("false"), ["g"], ["x"], "n").count() == 0


def test_timeline_of_no_days_and_local_input(spark):
    day = F.lit("2026-07-30").cast("date")
    row = spark.range(1).select(timeline.weeks(day, day, 1.0).alias("w"), timeline.bands(day, day, 1.0, "year").alias("b"), timeline.snap(F.lit(3.0), F.array().cast("array<double>"), 5.0).alias("s"))
    assert tuple(row.first()) == (None, None, 3.0)
    texts = spark.createDataFrame([("2026-07-30T23:30:00Z",), ("",), ("soon",), (None,)], "t string")
    assert [r[0] for r in texts.select(timeline.local_input("t", "Europe/Berlin")).collect()] == ["2026-07-31T01:30", "", "", ""]
    there = spark.createDataFrame([("2026-07-31T01:30",), ("",), ("now",)], "t string")
    assert [r[0] for r in there.select(timeline.from_local_input("t", "Europe/Berlin")).collect()] == ["2026-07-30T23:30:00.000Z", "", ""]
