"""Field matchers of the query language, free text, and the structured filter. All give two-valued columns."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, fields as dataclass_fields
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklight.functions.dates import week_end
from tracklight.functions.ioc import refang
from tracklight.functions.sla import sla_bucket, sla_state
from tracklight.model import Context, is_terminal
from tracklight.plans.query_language import compile_query, register_field, terms_column

_COMPARE = {"<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__", "=": "__eq__"}


def _signed(op: str, hit: Column) -> Column:
    """The predicate or its complement; ordering never matches."""
    hit = F.coalesce(hit, F.lit(False))
    return hit if op == "=" else ~hit if op == "!" else F.lit(False)


def _equals(name: str):
    return lambda op, value, ctx: _signed(op, F.lower(name) == value)


def _place(catalog: tuple, value: str) -> int:
    """Of a value given by id or label."""
    for part in (0, 1):
        for i, entry in enumerate(catalog):
            if entry[part].lower() == value:
                return i
    return -1


def _ranked(name: str, op: str, value: str, catalog: tuple) -> Column:
    """The first of a catalog ranks highest. A value that it doesn't know never matches, on any operator."""
    at = _place(catalog, value)
    if at < 0:
        return F.lit(False)
    if op in "=!":
        return _signed(op, F.lower(name) == catalog[at][0].lower())
    if op in (">", ">="):
        good = catalog[: at + (op == ">=")]
    else:
        good = catalog[at + (op == "<") :]
    return F.lower(name).isin(*(e[0].lower() for e in good)) if good else F.lit(False)


@register_field("key")
def key(op: str, value: str, ctx: Context) -> Column:
    k = F.lower("key")
    return _signed(op, (k != "") & ((k == value) | k.startswith(value + "-")))


for _field, _column in (("status", "status"), ("type", "issue_type"), ("verdict", "verdict"), ("bucket", "bucket")):
    register_field(_field)(_equals(_column))


@register_field("severity", "sev")
def severity(op: str, value: str, ctx: Context) -> Column:
    return _ranked("severity", op, value, ctx.severities)


@register_field("priority", "prio")
def priority(op: str, value: str, ctx: Context) -> Column:
    return _ranked("priority", op, value, ctx.priorities)


@register_field("assignee")
def assignee(op: str, value: str, ctx: Context) -> Column:
    who = ctx.me.lower() if value == "me" and ctx.me else value
    if who == "none":
        return _signed(op, F.size("assignees") <= 0)
    return _signed(op, F.exists("assignees", lambda a: F.lower(a) == who))


@register_field("tag")
def tag(op: str, value: str, ctx: Context) -> Column:
    return _signed(op, F.exists("tags", lambda t: F.lower(t) == value))


@register_field("progress")
def progress(op: str, value: str, ctx: Context) -> Column:
    try:
        number = float(value)
    except ValueError:
        return F.lit(False)
    if not math.isfinite(number):
        return F.lit(False)
    if op == "!":
        return F.col("progress") != number
    return getattr(F.col("progress"), _COMPARE[op])(number)


def due_keyword(value: str, ctx: Context) -> Column | None:
    """none, overdue, today, tomorrow, this-week or this-month; None if it's none of them."""
    due, today = F.col("due_d"), ctx.today_col
    if value == "none":
        return F.coalesce(F.col("due"), F.lit("")) == ""
    if value == "overdue":
        return (due < today) & ~is_terminal(ctx)
    if value in ("today", "tomorrow"):
        return due == F.date_add(today, int(value == "tomorrow"))
    if value == "this-week":
        return due.between(today, week_end(ctx))
    if value == "this-month":
        return (due >= today) & (F.trunc(due, "month") == F.trunc(today, "month"))
    return None


def due_target(value: str, ctx: Context) -> Column | None:
    """The date that `7d`, `2w`, `1m` or an ISO date names; None if it names none."""
    if match := re.fullmatch(r"(\d+)([dwm])", value):
        n = int(match[1])
        if match[2] == "m":
            return F.add_months(ctx.today_col, n)
        return F.date_add(ctx.today_col, n * (7 if match[2] == "w" else 1))
    try:
        return F.lit(date.fromisoformat(value)) if re.fullmatch(r"\d{4}-\d\d-\d\d", value) else None
    except ValueError:
        return None


@register_field("due")
def due(op: str, value: str, ctx: Context) -> Column:
    if op in "=!" and (hit := due_keyword(value, ctx)) is not None:
        return _signed(op, hit)
    target = due_target(value, ctx)
    if target is None:
        return F.lit(False)
    return F.col("due_d") != target if op == "!" else getattr(F.col("due_d"), _COMPARE[op])(target)


@register_field("archived")
def archived(op: str, value: str, ctx: Context) -> Column:
    if value not in ("true", "false"):
        return F.lit(False)
    return _signed(op, F.coalesce("archived", F.lit(False)) == (value == "true"))


@register_field("sla")
def sla(op: str, value: str, ctx: Context) -> Column:
    return _signed(op, sla_bucket(sla_state(ctx)) == value)


def has_ioc(value: Column) -> Column:
    """Whether an indicator holds the value, both refanged and in lower case."""
    return F.exists("iocs", lambda i: F.contains(F.lower(refang(i["value"])), value))


@register_field("ioc")
def ioc(op: str, value: str, ctx: Context) -> Column:
    wanted = F.lower(refang(F.lit(value)))
    return _signed(op, (wanted != "") & has_ioc(wanted))


def free_text(text: str) -> Column:
    """One substring of the key, title, status, an assignee, tag or indicator; or the id itself."""
    q = text.lower()
    if not q:
        return F.lit(True)
    hits = [
        F.lower("id") == q,
        (F.col("key") != "") & F.lower("key").contains(q),
        F.lower("title").contains(q),
        F.col("status").contains(q),
        F.exists("assignees", lambda a: F.lower(a).contains(q)),
        F.exists("tags", lambda t: F.lower(t).contains(q)),
        has_ioc(refang(F.lit(q))),
    ]
    return reduce(lambda a, b: a | b, (F.coalesce(h, F.lit(False)) for h in hits))


@dataclass(frozen=True)
class Filter:
    """The structured filter. Lists that are empty, and the due window `any`, let everything through."""

    text: str = ""
    statuses: tuple[str, ...] = ()
    priorities: tuple[str, ...] = ()
    severities: tuple[str, ...] = ()
    verdicts: tuple[str, ...] = ()
    assignees: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    due: str = "any"
    show_archived: bool = False

    def active(self) -> bool:
        """Whether it hides anything; archived cases don't count."""
        return any(getattr(self, f.name) for f in dataclass_fields(self) if f.name not in ("due", "show_archived")) or self.due != "any"

    def count(self) -> int:
        """Parts that are set; showing archived cases is one."""
        parts = sum(bool(getattr(self, f.name)) for f in dataclass_fields(self) if f.name != "due")
        return parts + (self.due != "any")

    def column(self, ctx: Context) -> Column:
        """The cheap tests come first; archived cases are out before any other is asked."""
        query = compile_query(self.text)
        tests = [] if self.show_archived else [~F.coalesce(F.col("archived"), F.lit(False))]
        for name, wanted in (("status", self.statuses), ("priority", self.priorities), ("severity", self.severities), ("verdict", self.verdicts)):
            tests += [F.col(name).isin(*wanted)] if wanted else []
        for name, wanted in (("assignees", self.assignees), ("tags", self.tags)):
            tests += [F.arrays_overlap(name, F.array(*map(F.lit, wanted)))] if wanted else []
        if self.due != "any":
            tests.append(due_keyword("none" if self.due == "no-date" else self.due, ctx))
        if query.terms:
            tests.append(terms_column(query, ctx))
        if query.free_text:
            tests.append(free_text(query.free_text))
        return reduce(lambda a, b: a & b, (F.coalesce(t, F.lit(False)) for t in tests), F.lit(True))


def search(cases: DataFrame, query: str | Filter, ctx: Context) -> DataFrame:
    """The cases that a query or filter lets through."""
    chosen = Filter(text=query) if isinstance(query, str) else query
    return cases.where(chosen.column(ctx))


def match_count(cases: DataFrame, chosen: Filter, ctx: Context) -> DataFrame:
    """matched, total (long): `n of m`."""
    return cases.agg(F.count_if(chosen.column(ctx)).alias("matched"), F.count("*").alias("total"))


def all_words(words: str, *columns: str) -> Column:
    """Every white-space part of the words is in the columns' joined text, whatever its case."""
    where = F.lower(F.concat_ws(" ", *columns))
    return reduce(lambda a, b: a & b, (where.contains(w) for w in words.lower().split()), F.lit(True))


def note_score(name: Column, query: str) -> Column:
    """How near a note's name is to a query, least first: edit distance, with a bonus for a prefix or substring."""
    n, q = F.lower(name), query.lower()
    bonus = F.when(n.startswith(q), -10.0).when(n.contains(q), -5.0).otherwise(0.0)
    return F.levenshtein(n, F.lit(q)) + bonus + F.length(name) * 0.01
