"""Settings of the engine's user: one small document, read once and kept on the driver."""

from __future__ import annotations

import copy

from tracklight import model
from tracklight.operators.capture import TEMPLATES

#: Verdicts that are no longer used, and statuses that end work where a saved one doesn't say.
RETIRED_VERDICTS, ENDING = ("pending", "duplicate"), ("done", "cancelled")


def defaults() -> dict:
    """Settings of a new user."""
    named = lambda catalog: [{"id": e[0], "label": e[1]} for e in catalog]
    return {
        "statuses": [{"id": i, "label": x, "complete": c} for i, x, c in model.STATUSES],
        "priorities": named(model.PRIORITIES),
        "issueTypes": named(model.ISSUE_TYPES),
        "severities": named(model.SEVERITIES),
        "verdicts": named(model.VERDICTS),
        "slaPolicies": {s: {"responseMins": a, "resolutionMins": b} for s, (a, b) in model.SLA_MINUTES.items()},
        "incidentTemplates": [{"id": i, "name": n} for i, n, *_ in TEMPLATES],
        "projectFilters": {},
        "collapsedTasks": {},
        "collapsedKanbanColumns": {},
    }


def migrate(saved: dict | None) -> tuple[dict, bool]:
    """(settings, whether they must be saved again) of what an older or this version has saved; `saved` isn't changed.

    Empty catalogs become the default ones, retired verdicts go, filters get the lists they lack. Statuses that don't say
    whether they end work are told; where ended work was once hidden everywhere, filters without statuses get those that don't end it.
    """
    out = defaults() | copy.deepcopy(saved or {})
    for name, value in defaults().items():
        if not out.get(name):
            out[name] = value
    out["verdicts"] = [v for v in out["verdicts"] if v.get("id") not in RETIRED_VERDICTS] or defaults()["verdicts"]
    filters = [entry["filter"] for entry in out["projectFilters"].values()]
    for chosen in filters:
        for name in ("severities", "verdicts"):
            if chosen.get(name) is None:
                chosen[name] = []
    changed = False
    for status in out["statuses"]:
        if status.get("complete") is None:
            status["complete"] = status.get("id") in ENDING
            changed = True
    if out.get("ganttHideDone") is True:
        for chosen in filters:
            chosen["statuses"] = chosen.get("statuses") or [s["id"] for s in out["statuses"] if not s["complete"]]
        changed = True
    return out, changed


def context(settings: dict, today: str, now: int, me: str = "") -> model.Context:
    """The operators' context of settings."""
    named = lambda name: tuple((e["id"], e.get("label", e["id"])) for e in settings[name])
    return model.Context(
        today=today,
        now=now,
        me=me,
        statuses=tuple((s["id"], s.get("label", s["id"]), bool(s.get("complete"))) for s in settings["statuses"]),
        priorities=named("priorities"),
        severities=named("severities"),
        verdicts=named("verdicts"),
        sla={s: (p["responseMins"], p["resolutionMins"]) for s, p in settings["slaPolicies"].items()},
    )
