"""Trees and schedules, against plain Python."""

import datetime as dt
import random

from test_query_language import CTX, make
from tracklight.operators import schedule, tree


def forest(spark, spec):
    """spec: id -> (parent, ord, more)."""
    return make(spark, *({"id": i, "parent_id": p, "ord": o} | m for i, (p, o, m) in spec.items()))


SPEC = {
    "a": ("", 0, {"collapsed": True}),
    "b": ("a", 1, {"status": "done"}),
    "c": ("a", 0, {}),
    "d": ("b", 0, {}),
    "e": ("", 1, {"issue_type": "epic", "archived": True}),
    "f": ("e", 0, {"issue_type": "epic"}),
    "g": ("f", 0, {}),
    "lost": ("nobody", 0, {}),
    "x": ("y", 0, {}),
    "y": ("x", 0, {}),
}


def test_flatten(spark):
    rows = tree.flatten(forest(spark, SPEC)).orderBy("path").collect()
    assert [(r.id, r.depth, r.visible) for r in rows] == [
        ("a", 0, True), ("c", 1, False), ("b", 1, False), ("d", 2, False), ("e", 0, True), ("f", 1, True), ("g", 2, True)
    ]


def test_filters_differ(spark):
    rows = forest(spark, SPEC)
    keep = rows.status != "done"
    assert {r.id for r in tree.filter_strict(rows, keep).collect()} == {"a", "c", "e", "f", "g"}
    assert {(r.id, r.parent_id) for r in tree.filter_promote(rows, keep).collect()} >= {("d", "a"), ("c", "a"), ("g", "f")}
    assert {r.id for r in tree.prune_archived(rows).collect()} == {"a", "b", "c", "d"}
    out = {r.id: r.depth for r in tree.sorted_rows(rows, "title", CTX, keep).collect()}
    assert out["d"] == 0 and out["lost"] == 0 and out["c"] == 1


def test_epics(spark):
    assert {r.id: r.epic_id for r in tree.nearest_epic(forest(spark, SPEC)).collect()} == {
        "a": "", "b": "", "c": "", "d": "", "e": "", "f": "e", "g": "f"
    }


def test_changes(spark):
    rows = forest(spark, {k: v for k, v in SPEC.items() if k in "abcdefg"})
    assert {r.id for r in tree.delete(rows, "b", "f").collect()} == {"a", "c", "e"}
    moved = {r.id: (r.parent_id, r.ord) for r in tree.move(rows, "b", "e").collect()}
    assert moved["b"] == ("e", 1) and moved["d"] == ("b", 0)
    assert {r.id: r.parent_id for r in tree.move(rows, "a", "d").collect()}["a"] == ""
    order = {r.id: r.ord for r in tree.reorder(rows, "b", "c").collect()}
    assert (order["b"], order["c"]) == (0, 1)
    new = make(spark, {"id": "n"})
    assert {r.id: (r.parent_id, r.ord) for r in tree.insert(rows, new, "zzz").collect()}["n"] == ("", 2)
    assert {r.id: (r.parent_id, r.ord) for r in tree.insert(rows, new, "a").collect()}["n"] == ("a", 2)


def test_empty_forest(spark):
    none = forest(spark, SPEC).limit(0)
    assert tree.flatten(none).count() == 0
    patches, cyclic = schedule.schedule(none, CTX)
    assert patches.count() == 0 and cyclic.count() == 0


def brute(cases, changed=None):
    """The forward pass in plain Python."""
    by = {c["id"]: c for c in cases}
    preds = {c["id"]: [d for d in c["dependencies"] if d in by] for c in cases}
    scope = set(by)
    if changed:
        scope, todo = set(), [changed]
        while todo:
            x = todo.pop()
            if x not in scope:
                scope.add(x)
                todo += [c for c in by if x in preds[c]]
    waits = {i: sum(d in scope for d in preds[i]) for i in scope}
    dates = {i: (c["start"], c["due"]) for i, c in by.items()}
    ready, done, patches = [i for i in scope if not waits[i]], [], {}
    day = lambda s, n: str(dt.date.fromisoformat(s) + dt.timedelta(n))
    while ready:
        i = ready.pop()
        done.append(i)
        c, (start, due) = by[i], dates[i]
        last = max((dates[d][1] for d in preds[i] if not by[d]["archived"]), default="")
        if last and c["status"] not in ("done", "cancelled"):
            first = day(last, 1)
            s, d = start, due
            if c["type"] == "milestone" or (not start and due):
                d = first if not due or due < first else due
            elif start and due:
                if start < first:
                    s, d = first, day(first, (dt.date.fromisoformat(due) - dt.date.fromisoformat(start)).days)
            elif not start or start < first:
                s = first
            if (s, d) != (start, due):
                patches[i] = dates[i] = (s, d)
        for n in scope:
            for _ in range(preds[n].count(i)):
                waits[n] -= 1
                if not waits[n]:
                    ready.append(n)
    return patches, scope - set(done)


def test_schedule_against_plain_python(spark):
    rng = random.Random(7)
    for round_ in range(3):
        n = 25
        day = lambda: rng.choice(["", "2026-08-%02d" % rng.randint(1, 28)])
        rows = []
        for i in range(n):
            deps = [str(rng.randrange(n + 2)) for _ in range(rng.choice([0, 0, 1, 2, 3]))]
            deps = [d for d in deps if round_ == 2 or int(d) < i]  # the last round has cycles
            start, due = sorted([day(), day()])
            rows.append({
                "id": str(i), "dependencies": deps, "start": start, "due": due, "archived": rng.random() < 0.2,
                "status": rng.choice(["todo", "todo", "done"]), "type": rng.choice(["task", "milestone"]),
            })
        for changed in (None, "3"):
            patches, cyclic = schedule.schedule(make(spark, *rows), CTX, changed)
            text = lambda d: "" if d is None else str(d)
            got = {r.id: (text(r.start_d), text(r.due_d)) for r in patches.collect()}
            assert (got, {r.id for r in cyclic.collect()}) == brute(rows, changed)


def test_links(spark):
    rows = make(spark, {"id": "a"}, {"id": "b", "dependencies": ["a", "gone"]}, {"id": "c", "dependencies": ["b"]})
    assert schedule.would_create_cycle(rows, "a", "c") and not schedule.would_create_cycle(rows, "c", "a")
    assert schedule.would_create_cycle(rows, "c", "c")
    assert not schedule.link_allowed(rows, "a", "b") and not schedule.link_allowed(rows, "b", "a") and schedule.link_allowed(rows, "a", "c")
