"""The case model: catalogs, defaults and the columns that every operator reads.

A case is a row. Unset text is '' and unset lists are empty, as in the files cases come from; dates and instants are
parsed once, by `enrich`, and are null where unset or unreadable. Predicates over them are two-valued: an
unreadable date makes a comparison false, never null. No operator reads a clock: `now` and `today` are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ids, labels and order of the default catalogs.
STATUSES = (
    ("todo", "To Do", False),
    ("in-progress", "In Progress", False),
    ("blocked", "Blocked", False),
    ("review", "In Review", False),
    ("done", "Done", True),
    ("cancelled", "Cancelled", True),
)
PRIORITIES = (("critical", "Critical"), ("high", "High"), ("medium", "Medium"), ("low", "Low"))
ISSUE_TYPES = (("epic", "Epic"), ("story", "Story"), ("task", "Task"), ("tuning", "Tuning"), ("incident", "Incident"))
SEVERITIES = (("sev1", "Critical"), ("sev2", "High"), ("sev3", "Medium"), ("sev4", "Low"), ("sev5", "Informational"))
VERDICTS = (
    ("true-positive", "True Positive"),
    ("false-positive", "False Positive"),
    ("security-testing", "True Positive - Security Testing"),
    ("anomalous-safe", "Anomalous Safe"),
)
BUCKETS = (
    ("today", "Today"),
    ("this-week", "This week"),
    ("next", "Next"),
    ("later", "Later"),
    ("someday", "Someday"),
    ("none", "No bucket"),
)
#: Minutes to respond and to resolve, by severity; other severities have no clock.
SLA_MINUTES = {"sev1": (60, 240), "sev2": (240, 1440), "sev3": (1440, 4320), "sev4": (2880, 10080)}
#: Hours of a handover's window, and days of a notice's lead.
HANDOVER_HOURS, LEAD_DAYS = 12, 2


@dataclass(frozen=True)
class Context:
    """What an operator needs to know besides its rows. `today` is ISO text, `now` epoch milliseconds."""

    today: str
    now: int
    me: str = ""
    statuses: tuple = STATUSES
    priorities: tuple = PRIORITIES
    severities: tuple = SEVERITIES
    verdicts: tuple = VERDICTS
    sla: dict = field(default_factory=lambda: dict(SLA_MINUTES))
    #: Whether cases carry their own project's statuses, as `catalogs.attach` gives them; `statuses` holds for all otherwise.
    per_project: bool = False

    @property
    def terminal(self) -> tuple[str, ...]:
        return tuple(s[0] for s in self.statuses if s[2])

    def but(self, **changes) -> Context:
        return replace(self, **changes)

    @property
    def today_col(self) -> Column:
        return F.lit(self.today).cast("date")

    @property
    def now_col(self) -> Column:
        return F.lit(self.now).cast("long")


CASE_SCHEMA = """project_id STRING, id STRING, key STRING, title STRING, description STRING, type STRING, issue_type STRING,
status STRING, priority STRING, severity STRING, verdict STRING, bucket STRING, start STRING, due STRING, completed STRING,
progress DOUBLE, detected_at STRING, responded_at STRING, contained_at STRING, resolved_at STRING, created_at STRING,
updated_at STRING, assignees ARRAY<STRING>, tags ARRAY<STRING>, attack ARRAY<STRING>, dependencies ARRAY<STRING>,
iocs ARRAY<STRUCT<type: STRING, value: STRING, note: STRING>>,
activity ARRAY<STRUCT<at: STRING, field: STRING, `from`: STRING, `to`: STRING>>,
comments ARRAY<STRUCT<at: STRING, text: STRING>>, time_estimate DOUBLE,
time_logs ARRAY<STRUCT<date: STRING, hours: DOUBLE, note: STRING>>,
recurrence STRUCT<interval: STRING, every: INT, endDate: STRING>, custom_fields MAP<STRING, STRING>,
parent_id STRING, ord INT, archived BOOLEAN, collapsed BOOLEAN, file_path STRING"""


def parse_date(text: Column | str) -> Column:
    """A calendar date of YYYY-MM-DD; null for anything else."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def parse_instant(text: Column | str) -> Column:
    """Epoch milliseconds of an ISO instant; null if it can't be read. Without a zone it is UTC."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.unix_millis(text.try_cast("timestamp")))


#: Parsed companions of the text columns.
DATES = {"start": "start_d", "due": "due_d", "completed": "completed_d"}
INSTANTS = {f"{x}_at": f"{x}_ms" for x in ("detected", "responded", "contained", "resolved", "created")}


def enrich(cases: DataFrame) -> DataFrame:
    """`cases` with the parsed companions of those text columns that are there and not parsed yet."""
    have = set(cases.columns)
    new = {c: parse_date(t) for t, c in DATES.items() if t in have and c not in have}
    new |= {c: parse_instant(t) for t, c in INSTANTS.items() if t in have and c not in have}
    return cases.withColumns(new) if new else cases


def rank(catalog: tuple, value: Column, unknown: int = 999) -> Column:
    """Place of an id in a catalog, from 0; `unknown` for ids that it doesn't have."""
    pairs = [x for i, e in enumerate(catalog) for x in (F.lit(e[0]), F.lit(i))]
    return F.coalesce(F.element_at(F.create_map(*pairs), value), F.lit(unknown)) if pairs else F.lit(unknown)


def label(catalog: tuple, value: Column) -> Column:
    """Label of an id in a catalog; the id itself if it isn't there."""
    pairs = [x for e in catalog for x in (F.lit(e[0]), F.lit(e[1]))]
    return F.coalesce(F.element_at(F.create_map(*pairs), value), value) if pairs else value


#: Columns of a case's project: ids of its statuses in their order, and those of them that end work.
STATUS_IDS, TERMINAL_IDS = "status_ids", "terminal_ids"


def is_terminal(ctx: Context, status: Column | str = "status") -> Column:
    """Whether work on a case of this status is over; an unknown status isn't. By the case's project where the context says so."""
    status = F.col(status) if isinstance(status, str) else status
    over = F.array_contains(F.col(TERMINAL_IDS), status) if ctx.per_project else status.isin(*ctx.terminal)
    return F.coalesce(over, F.lit(False))


def status_rank(ctx: Context, unknown: int = 999) -> Column:
    """Place of a case's status in its catalog, from 0."""
    if not ctx.per_project:
        return rank(ctx.statuses, F.col("status"), unknown)
    place = F.array_position(STATUS_IDS, F.col("status"))
    return F.when(place > 0, (place - 1).cast("int")).otherwise(F.lit(unknown))


def has_status(ctx: Context) -> Column:
    """Whether a case's status is in its catalog."""
    known = F.array_contains(F.col(STATUS_IDS), F.col("status")) if ctx.per_project else F.col("status").isin(*(s[0] for s in ctx.statuses))
    return F.coalesce(known, F.lit(False))
