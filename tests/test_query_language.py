"""The query language and the structured filter on hand-made cases. The clock is 2026-07-30, a Thursday."""

import pytest
from pyspark.sql import functions as F

from tracklight.model import CASE_SCHEMA, Context, enrich
from tracklight.operators.predicates import Filter, search
from tracklight.plans.query_language import CompiledQuery, Term, compile_query, fields, register_field, tokens

CTX = Context(today="2026-07-30", now=1_785_412_800_000, me="Alice")  # 12:00 UTC
BASE = {
    "project_id": "p", "id": "x", "key": "", "title": "", "status": "todo", "priority": "medium", "severity": "", "verdict": "", "bucket": "none",
    "type": "task", "issue_type": "task", "start": "", "due": "", "completed": "", "progress": 0.0, "detected_at": "", "responded_at": "",
    "contained_at": "", "resolved_at": "", "created_at": "2026-07-01T00:00:00Z", "assignees": [], "tags": [], "dependencies": [], "iocs": [],
    "archived": False, "parent_id": "", "ord": 0, "collapsed": False,
}


def make(spark, *rows):
    import pyspark.sql.types as T

    schema = T._parse_datatype_string(CASE_SCHEMA)
    full = [tuple((BASE | {"id": str(i)} | r).get(f.name) for f in schema.fields) for i, r in enumerate(rows)]
    return enrich(spark.createDataFrame(full, schema))


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_tokens_keep_quoted_runs():
    assert tokens('assignee:"John Smith"  x\ty') == ['assignee:"John Smith"', "x", "y"]
    assert tokens('a "b c') == ["a", '"b c']


def test_compile():
    q = compile_query('sev:>=High phish due: nope:1 "two words" SLA:!ok')
    assert q == CompiledQuery((Term("sev", ">=", "high"), Term("sla", "!", "ok")), "phish due: nope:1 two words")
    assert compile_query("constructor:x").free_text == "constructor:x"
    assert compile_query("") == CompiledQuery((), "")


def test_fields():
    assert set(fields()) >= set("key status type sev severity prio priority verdict assignee tag bucket progress due archived sla ioc".split())


@pytest.mark.parametrize(
    ("query", "found"),
    [
        ("key:soc-1", ["0"]),
        ("key:SOC", ["0", "1"]),
        ("key:!soc", ["2", "3"]),
        ("key:>soc", []),
        ("sev:>=high", ["0", "1"]),
        ("sev:>high", ["0"]),
        ("sev:<sev1", ["1", "2"]),
        ("sev:!unheard", []),
        ("sev:!sev1", ["1", "2", "3"]),
        ("assignee:me", ["0"]),
        ("assignee:none", ["2", "3"]),
        ('assignee:!"john smith"', ["0", "2", "3"]),
        ("tag:!phishing", ["1", "2", "3"]),
        ("progress:>=50", ["1"]),
        ("progress:!abc", []),
        ("due:overdue", ["0"]),
        ("due:!overdue", ["1", "2", "3"]),
        ("due:today", ["1"]),
        ("due:none", ["3"]),
        ("due:<=7d", ["0", "1", "2"]),
        ("due:>=2026-08-01", ["2"]),
        ("due:!2026-07-29", ["1", "2"]),
        ("due:this-week", ["1", "2"]),
        ("ioc:evil[.]com", ["2"]),
        ("ioc:!evil.com", ["0", "1", "3"]),
        ("hxxp://bad", []),
        ("EVIL.com", ["2"]),
        ("type:incident sla:breached", ["0"]),
        ("archived:maybe", []),
        ("status:todo work now", []),
        ("work on", ["1"]),
    ],
)
def test_terms(spark, query, found):
    rows = make(
        spark,
        {"key": "SOC-1", "severity": "sev1", "assignees": ["Alice"], "tags": ["Phishing"], "due": "2026-07-29", "issue_type": "incident"},
        {"key": "SOC-12", "severity": "sev2", "assignees": ["John Smith"], "progress": 50.0, "due": "2026-07-30", "title": "Work on it"},
        {"severity": "sev3", "due": "2026-08-02", "iocs": [("domain", "evil.com", "")]},
        {"severity": "odd", "due": ""},
    )
    assert ids(search(rows, query, CTX)) == found


def test_unreadable_dates_never_match(spark):
    rows = make(spark, {"due": "2026"}, {"due": "2026-02-30"})
    for query in ("due:<2030-01-01", "due:!2026-07-30", "due:overdue"):
        assert ids(search(rows, query, CTX)) == []
    assert ids(search(rows, "due:!none", CTX)) == ["0", "1"]


def test_window_of_a_sunday_ends_a_week_later(spark):
    rows = make(spark, {"due": "2026-08-09"}, {"due": "2026-08-10"})
    assert ids(search(rows, "due:this-week", CTX.but(today="2026-08-02"))) == ["0"]


def test_filter(spark):
    rows = make(spark, {"archived": True, "status": "done"}, {"status": "done", "tags": ["a", "b"]}, {"status": "todo", "due": "2026-07-01"})
    assert ids(search(rows, Filter(statuses=("done",)), CTX)) == ["1"]
    assert ids(search(rows, Filter(statuses=("done",), show_archived=True), CTX)) == ["0", "1"]
    assert ids(search(rows, Filter(tags=("b", "z")), CTX)) == ["1"]
    assert ids(search(rows, Filter(due="overdue"), CTX)) == ["2"]
    assert ids(search(rows, Filter(due="no-date"), CTX)) == ["1"]
    assert not Filter(show_archived=True).active() and Filter(show_archived=True).count() == 1
    assert Filter(due="overdue", tags=("x",)).active() and Filter(due="overdue", tags=("x",)).count() == 2


def test_new_field(spark):
    @register_field("titlelen")
    def title_length(op, value, ctx):
        return F.length("title") == int(value)

    assert ids(search(make(spark, {"title": "abc"}, {"title": "ab"}), "titlelen:3", CTX)) == ["0"]


def test_empty(spark):
    assert ids(search(make(spark).limit(0), "sev:>=high", CTX)) == []
