"""The vault, imports, change capture and the streaming notices."""

import datetime as dt

import pytest


from test_query_language import CTX, make
from tracklight.operators import capture, imports
from tracklight.sources import vault
from tracklight.streaming import notices

NOTE = """---
pm-task: true
id: t1
title: "A \\"quoted\\" title"
status: blocked
bucket: nonsense
progress: lots
assignees: [Ann, Bo]
due: 2026-08-01
subtaskIds: [t3, t2]
iocs:
  - type: ip
    value: "1.2.3.4"
  - type: cheese
    value: "x"
activity:
  - at: "2026-07-01T00:00:00Z"
    field: status
---
Body text

## Comments

> **2026-07-01 10:00** — first
> more
a stray line

Parent: [[Other]]

## Subtasks
- [ ] [[x]]
"""


def test_hydrate():
    matter, body = vault.split_front_matter(NOTE)
    case = vault.hydrate(matter, body, "Cases/p_tasks/Archive/a.md")
    assert case["title"] == 'A "quoted" title' and case["bucket"] == "none" and case["progress"] == 0.0 and case["due"] == "2026-08-01"
    assert case["iocs"] == [{"type": "ip", "value": "1.2.3.4", "note": ""}] and case["archived"]
    assert case["comments"] == [{"at": "2026-07-01 10:00", "text": "first\nmore"}, {"at": "", "text": "a stray line"}]
    assert case["description"] == "Body text"
    assert vault.split_front_matter("---\n: [\n---\nx") == (None, "---\n: [\n---\nx")
    assert vault.split_front_matter("no matter") == (None, "no matter")


def test_folder_is_read_and_healed(spark, tmp_path):
    (tmp_path / "Cases" / "P").mkdir(parents=True)
    write = lambda name, text: (tmp_path / "Cases" / "P" / name).write_text(text)
    write("one.md", NOTE)
    write("two.md", "---\npm-task: true\nid: t2\ntitle: Two\n---\n")
    write("three.md", "---\npm-task: true\nid: t3\ntitle: Three\n---\n")
    write("four.md", "---\npm-task: true\nid: t4\ntitle: Four\nparentId: t1\n---\n")
    write("five.md", "---\npm-task: true\nid: t5\ntitle: Five\nparentId: gone\n---\n")
    write("P.md", "---\npm-project: true\nid: P\ntitle: Proj\ntaskIds: [t5, t1]\n---\n")
    write("other.md", "just a note")
    notes = vault.read_notes(spark, str(tmp_path))
    placed = {r.id: (r.parent_id, r.ord) for r in vault.assemble(notes).collect()}
    assert placed == {"t1": ("", 1), "t2": ("t1", 1), "t3": ("t1", 0), "t4": ("t1", 2), "t5": ("", 0)}
    assert [r.title for r in vault.projects(notes).collect()] == ["Proj"]


def test_emitter():
    lines = vault.yaml_lines({"a": 'x "y"\n\\', "n": 1.5, "b": True, "e": [], "l": ["p", "q"], "d": [{"k": "v", "m": 2}, {}], "o": {}})
    assert lines == ['a: "x \\"y\\"\\n\\\\"', "n: 1.5", "b: true", "e: []", 'l: ["p", "q"]', "d:", '  - k: "v"', "    m: 2", "o: {}"]


def test_import_forest(spark):
    rows = [("b", 0, "x", ["y"], ["z", "out"]), ("b", 1, "y", ["out", "x"], []), ("b", 2, "z", ["z", "y"], ["x"]), ("b", 3, "w", [], None)]
    df = spark.createDataFrame(rows, "batch string, pos int, path string, parents array<string>, blocked_by array<string>")
    out = {r.path: (r.parent, r.dependencies) for r in imports.build_forest(df).collect()}
    assert out == {"x": ("y", ["z"]), "y": ("", []), "z": ("y", ["x"]), "w": ("", [])}


def test_patches_log_and_stamp(spark):
    old = make(spark, {"id": "a", "issue_type": "incident", "assignees": ["Ann"]}, {"id": "b", "status": "done", "completed": "2026-07-01"})
    patches = spark.createDataFrame([("a", "done", ["Ann", "Bo"]), ("b", "todo", None)], "id string, status string, assignees array<string>")
    old = old.fillna("").withColumn("activity", old.activity)
    from pyspark.sql import functions as F

    old = old.withColumn("activity", F.coalesce("activity", F.array().cast(capture.ENTRY)))
    new = {r.id: r for r in capture.apply_patches(old, patches, CTX, "2026-07-30T12:00:00Z").collect()}
    a, b = new["a"], new["b"]
    assert (a.status, a.completed, a.responded_at, a.resolved_at) == ("done", "2026-07-30", "2026-07-30T12:00:00Z", "2026-07-30T12:00:00Z")
    assert [(e.field, e["from"], e.to) for e in a.activity] == [("status", "todo", "done"), ("assignees", "Ann", "Ann, Bo")]
    assert (b.status, b.completed, b.responded_at or "") == ("todo", "", "")


def _stream(spark, path, frames, schema):
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        del i
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_due_notices_once(spark, tmp_path):
    t = dt.datetime(2026, 7, 30, 12)
    rows = [("a", "todo", dt.date(2026, 7, 29), t), ("b", "done", dt.date(2026, 7, 1), t), ("c", "todo", dt.date(2026, 8, 1), t), ("d", "todo", dt.date(2026, 9, 1), t)]
    stream = _stream(spark, tmp_path / "in", [rows, rows], "id string, status string, due_d date, ts timestamp")
    query = notices.due_notices(stream, ("done",)).writeStream.format("memory").queryName("due").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.id, r.kind) for r in spark.table("due").collect()) == [("a", "overdue"), ("c", "soon")]


def test_breach_is_told_once(spark, tmp_path):
    t = lambda m: dt.datetime(2026, 7, 30, 12) + dt.timedelta(minutes=m)
    frames = [
        [("a", "response", t(30), False, t(0)), ("b", "response", t(30), False, t(0))],
        [("b", "response", t(30), True, t(10))],
        [("a", "response", t(30), False, t(40)), ("z", "response", t(900), False, t(120))],
        [("a", "response", t(30), False, t(50)), ("z", "response", t(900), False, t(180))],
    ]
    stream = _stream(spark, tmp_path / "in", frames, "id string, phase string, deadline timestamp, done boolean, ts timestamp")
    query = notices.breach_notices(stream).writeStream.format("memory").queryName("breach").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert [(r.id, r.phase) for r in spark.table("breach").collect()] == [("a", "response")]


def test_notes_are_read_back_as_written(spark, tmp_path):
    rows = [("Cases/P/a b.md", "---\npm-task: true\nid: a\ntitle: A+1\n---\n\nBody é\n"), ("Cases/P/Archive/c.md", "---\npm-task: true\nid: c\nparentId: a\n---\n")]
    df = spark.createDataFrame(rows, "file_path string, value string")
    folder = str(tmp_path / "vault")
    assert vault.write_notes(df, folder) == 2 and vault.write_notes(df, folder) == 2
    assert (tmp_path / "vault" / "Cases" / "P" / "a b.md").read_text() == rows[0][1]
    assert sorted(str(p.relative_to(folder)) for p in (tmp_path / "vault").rglob("*") if p.is_file()) == sorted(r[0] for r in rows)
    back = {r.id: r for r in vault.read_notes(spark, folder).collect()}
    assert {i: r.file_path for i, r in back.items()} == {"a": rows[0][0], "c": rows[1][0]}
    assert back["a"].title == "A+1" and back["a"].description == "Body é" and back["c"].archived and back["c"].parent_id == "a"
    with pytest.raises(Exception, match="leads out"):
        vault.write_notes(spark.createDataFrame([("../x.md", "")], "file_path string, value string"), folder)


def test_subtree_of_a_cycle_and_free_names(spark):
    from tracklight.operators import capture, tree

    rows = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b"), ("d", "")], "id string, parent_id string")
    assert sorted((r.id, r.depth) for r in tree.subtree(rows, "a").collect()) == [("a", 0), ("b", 1), ("c", 2)]
    taken = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    many = ["P (copy)", *(f"P (copy {n})" for n in range(2, 1500))]
    for names, free in ((many, "P (copy 1500)"), (many[1:], "P (copy)"), (["P (copy)", "P (copy 3)", "P (copy x)", "P (copy 1)"], "P (copy 2)")):
        assert [r.name for r in capture.free_name(taken(names), "P").collect()] == [free]
