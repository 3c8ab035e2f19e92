"""Reports over cases: counts by week, time in status, SLA compliance, durations, boards, lanes and the handover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklight.functions.dates import iso_week_label, utc_date
from tracklight.functions.ioc import ioc_line
from tracklight.functions.sla import at_risk, format_remaining, sla_state
from tracklight.model import BUCKETS, HANDOVER_HOURS, LEAD_DAYS, Context, has_status, is_terminal, label, rank
from tracklight.operators.common import checkpoint

HOUR = 3_600_000
WEEK = 7 * 24 * HOUR


def incidents(cases: DataFrame) -> DataFrame:
    return cases.where(F.col("issue_type") == "incident")


def opened_closed_per_week(cases: DataFrame, weeks: int, ctx: Context) -> DataFrame:
    """label, opened, closed (long) for each of the last `weeks` ISO weeks, zeros included, oldest first."""
    spark = cases.sparkSession
    calendar = spark.range(weeks).select(
        F.col("id").alias("n"), iso_week_label(utc_date(ctx.now_col - (weeks - 1 - F.col("id")) * WEEK)).alias("label")
    )
    day = F.explode(F.array(F.struct(utc_date(F.col("created_ms")).alias("d"), F.lit(1).alias("o")), F.struct(F.col("completed_d").alias("d"), F.lit(0).alias("o"))))
    since = F.date_sub(utc_date(ctx.now_col), weeks * 7 + 7)
    events = cases.select(day.alias("e")).select("e.*").where(F.col("d") >= since)
    counted = events.groupBy(iso_week_label(F.col("d")).alias("label")).agg(F.count_if(F.col("o") == 1).alias("opened"), F.count_if(F.col("o") == 0).alias("closed"))
    out = calendar.join(counted, "label", "left").orderBy("n")
    return out.select("label", F.coalesce("opened", F.lit(0)).alias("opened"), F.coalesce("closed", F.lit(0)).alias("closed"))


def time_in_status(cases: DataFrame, transitions: DataFrame, ctx: Context) -> DataFrame:
    """status, total_ms (long), most first: how long cases have been in each status.

    transitions has id, at_ms, pos, from, to. A case without one has been in its status all the time. A case that can't
    say when it was created, or whose resolution can't be read, isn't counted.
    """
    unset = F.coalesce("resolved_at", F.lit("")) == ""
    span = cases.where("created_ms is not null").select(
        "id", "status", F.col("created_ms").alias("start"), F.when(unset, ctx.now_col).otherwise(F.col("resolved_ms")).alias("end")
    )
    span = span.where("end is not null")
    moves = transitions.where("at_ms is not null").join(span.drop("status"), "id")
    clamped = F.least(F.greatest("start", "at_ms"), "end")
    w = Window.partitionBy("id").orderBy("at_ms", "pos")
    steps = moves.select(
        "id", "start", "end", F.col("from").alias("was"), F.col("to").alias("now_in"), clamped.alias("at"),
        F.lag(clamped).over(w).alias("before"), F.lead(clamped).over(w).alias("after"),
    )
    first = F.when(F.col("before").isNull(), F.struct(F.col("was").alias("status"), (F.col("at") - F.col("start")).alias("ms")))
    rest = F.struct(F.col("now_in").alias("status"), (F.coalesce("after", "end") - F.col("at")).alias("ms"))
    spent = steps.select(F.explode(F.array_compact(F.array(first, rest))).alias("s")).select("s.*")
    still = span.join(moves.select("id").distinct(), "id", "left_anti").select("status", (F.col("end") - F.col("start")).alias("ms"))
    total = spent.union(still).groupBy("status").agg(F.sum(F.greatest("ms", F.lit(0))).alias("total_ms"))
    return total.orderBy(F.desc("total_ms"), "status")


def verdict_breakdown(cases: DataFrame) -> DataFrame:
    """verdict, count (long) of incidents, most first; '' where none is recorded."""
    return incidents(cases).groupBy("verdict").count().orderBy(F.desc("count"), "verdict")


def _severity() -> Column:
    return F.when(F.coalesce("severity", F.lit("")) == "", "none").otherwise(F.col("severity"))


def sla_compliance(cases: DataFrame, ctx: Context) -> DataFrame:
    """severity, met, breached, no_data, open (long) of incidents."""
    rows = incidents(cases).select(_severity().alias("severity"), sla_state(ctx).alias("s"))
    done = F.coalesce(F.col("s.done"), F.lit(False))
    return (
        rows.groupBy("severity")
        .agg(
            F.count_if(done & ~F.col("s.breached")).alias("met"),
            F.count_if(done & F.col("s.breached")).alias("breached"),
            F.count_if(F.col("s").isNull()).alias("no_data"),
            F.count_if(F.col("s").isNotNull() & ~done).alias("open"),
        )
        .orderBy("severity")
    )


def lifecycle_durations(cases: DataFrame) -> DataFrame:
    """phase, severity (null: overall), n (long), mean_ms, median_ms (double) of respond, contain and resolve.

    Measured from detection, over the incidents that have both instants in order; the median is exact.
    """
    phases = [("respond", "responded_ms"), ("contain", "contained_ms"), ("resolve", "resolved_ms")]
    ends = F.explode(F.array(*(F.struct(F.lit(p).alias("phase"), F.col(c).alias("end")) for p, c in phases)))
    rows = incidents(cases).select(_severity().alias("severity"), F.col("detected_ms").alias("start"), ends.alias("e"))
    rows = rows.select("severity", F.col("e.phase").alias("phase"), (F.col("e.end") - F.col("start")).alias("ms")).where("ms >= 0")
    return rows.sparkSession.sql(
        """SELECT phase, severity, count(*) AS n, avg(ms) AS mean_ms, CAST(median(ms) AS DOUBLE) AS median_ms
        FROM {rows} GROUP BY GROUPING SETS ((phase), (phase, severity))""",
        rows=rows,
    )


def report_summary(cases: DataFrame, ctx: Context) -> DataFrame:
    """One row: open, incidents, closed_this_week, true_positives (long), sla_met_pct (int, null before any clock is done)."""
    state = sla_state(ctx)
    done = F.coalesce(state["done"], F.lit(False))
    met, late = F.count_if(done & ~state["breached"]), F.count_if(done & state["breached"])
    this_week = iso_week_label(F.col("completed_d")) == iso_week_label(utc_date(ctx.now_col))
    is_incident = F.col("issue_type") == "incident"
    return cases.agg(
        F.count_if(~is_terminal(ctx)).alias("open"),
        F.count_if(is_incident).alias("incidents"),
        F.count_if(this_week).alias("closed_this_week"),
        F.count_if(is_incident & (F.col("verdict") == "true-positive")).alias("true_positives"),
        F.round(F.try_divide(met, met + late) * 100).cast("int").alias("sla_met_pct"),
    )


def open_by_severity(cases: DataFrame, ctx: Context) -> DataFrame:
    """severity, count (long) of open incidents in the catalog's order, '' after it, unknown ones last."""
    known = (*ctx.severities, ("", ""))
    rows = incidents(cases).where(~is_terminal(ctx)).groupBy(F.coalesce("severity", F.lit("")).alias("severity")).count()
    return rows.orderBy(rank(known, F.col("severity")), "severity")


def project_progress(cases: DataFrame, ctx: Context) -> DataFrame:
    """project_id, total, done (long)."""
    return cases.groupBy("project_id").agg(F.count("*").alias("total"), F.count_if(is_terminal(ctx)).alias("done"))


def logged_hours(cases: DataFrame) -> DataFrame:
    """id, logged (double), over (boolean), pct (int, null without an estimate)."""
    logged = F.aggregate("time_logs", F.lit(0.0), lambda n, x: n + F.coalesce(x["hours"], F.lit(0.0)))
    estimate = F.coalesce("time_estimate", F.lit(0.0))
    return cases.select("id", logged.alias("logged"), estimate.alias("_e")).select(
        "id",
        "logged",
        ((F.col("_e") > 0) & (F.col("logged") > F.col("_e"))).alias("over"),
        F.when(F.col("_e") > 0, F.round(F.col("logged") / F.col("_e") * 100).cast("int")).alias("pct"),
    )


def latest_activity(activity: DataFrame) -> DataFrame:
    """The entry of the greatest instant of each case, the first of equals: id, at, field, from, to."""
    w = Window.partitionBy("id").orderBy(F.desc("at"), "pos")
    return activity.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("id", "at", "field", "from", "to")


def distinct_values(cases: DataFrame, column: str, more: tuple[str, ...] = ()) -> DataFrame:
    """value: all of a list column's and some more, '' left out, in binary order."""
    spark = cases.sparkSession
    found = cases.select(F.explode(column).alias("value"))
    if more:
        found = found.union(spark.createDataFrame([(m,) for m in more], "value string"))
    return found.where("value <> ''").distinct().orderBy("value")


def wip_counts(cases: DataFrame, ctx: Context, limits: dict[str, int], lane: Column | None = None) -> DataFrame:
    """lane, status, count (long), over: cards in each column of a board, against the column's limit."""
    lane = F.lit("all") if lane is None else lane
    shown = cases.where(has_status(ctx))
    counted = shown.groupBy(lane.alias("lane"), "status").count()
    pairs = [x for s, n in limits.items() for x in (F.lit(s), F.lit(n))]
    limit = F.element_at(F.create_map(*pairs), F.col("status")) if pairs else F.lit(None).cast("int")
    return counted.withColumn("over", F.coalesce(F.col("count") > limit, F.lit(False)))


def backlog(cases: DataFrame) -> DataFrame:
    """bucket, label, count (long) in the catalog's order, empty ones left out."""
    rows = cases.where(F.col("bucket").isin(*(b[0] for b in BUCKETS))).groupBy("bucket").count()
    return rows.orderBy(rank(BUCKETS, F.col("bucket"))).select("bucket", label(BUCKETS, F.col("bucket")).alias("label"), "count")


def lanes(cases: DataFrame, by: str, ctx: Context, epics: DataFrame | None = None) -> DataFrame:
    """lane_key, lane_label, lane_pos, count (long): a board's lanes in their order.

    by: none, epic (epics has id and epic_id; the order of the first case, tree_pos), assignee (the first one, by
    label), severity (the catalog's order, unknown ones by first case) or bucket (unknown ones are dropped). What has
    none is the last lane.
    """
    if by == "none":
        rows = cases.groupBy(F.lit("all").alias("lane_key"), F.lit("").alias("lane_label")).count()
        return rows.select("lane_key", "lane_label", F.lit(1).alias("lane_pos"), "count")
    if by == "epic":
        titles = cases.select(F.col("id").alias("_e"), F.when(F.col("key") != "", F.concat("key", F.lit(" · "), "title")).otherwise(F.col("title")).alias("_t"))
        rows = cases.join(epics, "id", "left").join(titles, F.col("epic_id") == F.col("_e"), "left")
        keyed = rows.select(F.coalesce("epic_id", F.lit("")).alias("lane_key"), F.coalesce("_t", F.lit("No epic")).alias("lane_label"), *_pos(cases))
        order = [F.col("lane_key") == "", F.col("first")]
    elif by == "assignee":
        who = F.coalesce(F.get("assignees", F.lit(0)), F.lit(""))
        keyed = cases.select(who.alias("lane_key"), F.when(who == "", "Unassigned").otherwise(who).alias("lane_label"), *_pos(cases))
        order = [F.col("lane_key") == "", F.collate("lane_label", "UNICODE")]
    elif by == "severity":
        sev = F.coalesce("severity", F.lit(""))
        keyed = cases.select(sev.alias("lane_key"), F.when(sev == "", "No severity").otherwise(label(ctx.severities, sev)).alias("lane_label"), *_pos(cases))
        order = [F.col("lane_key") == "", rank(ctx.severities, F.col("lane_key")), F.col("first")]
    elif by == "bucket":
        keyed = cases.where(F.col("bucket").isin(*(b[0] for b in BUCKETS)))
        keyed = keyed.select(F.col("bucket").alias("lane_key"), label(BUCKETS, F.col("bucket")).alias("lane_label"), *_pos(cases))
        order = [rank(BUCKETS, F.col("lane_key"))]
    else:
        raise ValueError(f"no lanes by {by}")
    counted = keyed.groupBy("lane_key", "lane_label").agg(F.count("*").alias("count"), F.min("_pos").alias("first"))
    place = F.row_number().over(Window.orderBy(*order, "lane_key"))  # a row for each lane
    return counted.select("lane_key", "lane_label", place.alias("lane_pos"), "count")


def _pos(cases: DataFrame) -> list[Column]:
    return [F.col("tree_pos" if "tree_pos" in cases.columns else "id").alias("_pos")]


def key_prefix(cases: DataFrame) -> DataFrame:
    """prefix, count, first_pos: prefixes of keys in titles, the one to use first."""
    prefix = F.regexp_extract("title", r"^([A-Z][A-Z0-9]+)-(\d+):?\s*", 1)
    rows = cases.select(prefix.alias("prefix"), *_pos(cases)).where("prefix <> ''")
    return rows.groupBy("prefix").agg(F.count("*").alias("count"), F.min("_pos").alias("first_pos")).orderBy(F.desc("count"), "first_pos")


#: Fewest days that a timeline shows, by granularity.
LEAST_DAYS = {"day": 30, "week": 90, "month": 365, "quarter": 365}


def timeline_extent(cases: DataFrame, ctx: Context, granularity: str = "week") -> DataFrame:
    """One row: first_day, last_day of a timeline over all dates and today, with 7 days before and 14 after.

    A span that is too short grows at both ends; but for days, it begins with a month.
    """
    low = F.least(F.min("start_d"), F.min("due_d"), ctx.today_col)
    high = F.greatest(F.max("start_d"), F.max("due_d"), ctx.today_col)
    ends = cases.agg(F.date_sub(low, 7).alias("lo"), F.date_add(high, 14).alias("hi"))
    extra = F.greatest(F.ceil((LEAST_DAYS[granularity] - F.datediff("hi", "lo")) / 2), F.lit(0)).cast("int")
    first = F.date_sub("lo", extra)
    first = first if granularity == "day" else F.trunc(first, "month").cast("date")
    return ends.select(first.alias("first_day"), F.date_add("hi", extra).alias("last_day"))


# The shift handover.


def _label() -> Column:
    return F.when(F.col("key") != "", F.concat_ws(" ", "key", "title")).otherwise(F.col("title"))


def _present(cases: DataFrame) -> DataFrame:
    return cases.where(~F.coalesce("archived", F.lit(False)))


def open_incidents(cases: DataFrame, latest: DataFrame, ctx: Context) -> DataFrame:
    """id, severity, severity_label, label, line: open incidents in the handover's words, one line each."""
    state = sla_state(ctx)
    left = format_remaining(state["remaining_ms"])
    sla_text = (
        F.when(state.isNull(), "no target")
        .when(state["breached"], F.concat(F.lit("target breached "), left))
        .otherwise(F.concat(state["phase"], F.lit(" target in "), left))
    )
    rows = incidents(_present(cases)).where(~is_terminal(ctx))
    last = latest.select(F.col("id").alias("_a"), F.concat(F.lit(" · last: "), "field", F.lit(" → "), "to", F.lit(" at "), "at").alias("_last"))
    rows = rows.join(last, F.col("id") == F.col("_a"), "left")
    line = F.concat(F.lit("- "), _label(), F.lit(" — "), "status", F.lit(" · "), sla_text, F.coalesce("_last", F.lit("")))
    sev = F.col("severity")
    return rows.select(
        "id", "severity", F.when(sev == "", "No severity").otherwise(label(ctx.severities, sev)).alias("severity_label"), _label().alias("label"), line.alias("line")
    )


def ioc_lines(cases: DataFrame, most: int = 8) -> DataFrame:
    """id, pos, line: a case's first `most` indicators, defanged, and how many more there are."""
    lines = F.transform(F.slice("iocs", 1, most), lambda i: F.concat(F.lit("  - "), ioc_line(i)))
    more = F.when(F.size("iocs") > most, F.array(F.concat(F.lit("  - +"), (F.size("iocs") - most).cast("string"), F.lit(" more"))))
    return cases.select("id", F.posexplode(F.concat(lines, F.coalesce(more, F.expr("slice(array(''), 1, 0)")))).alias("pos", "line"))


def changed_in_window(cases: DataFrame, activity: DataFrame, ctx: Context, hours: int = HANDOVER_HOURS) -> DataFrame:
    """id, label, pos, line: activity of the last `hours`, both ends included, of cases that aren't archived."""
    age = ctx.now_col - F.col("at_ms")
    recent = activity.where((age >= 0) & (age <= hours * HOUR))
    named = _present(cases).select("id", _label().alias("label"))
    was = F.when(F.coalesce("from", F.lit("")) == "", "(unset)").otherwise(F.col("from"))
    line = F.concat(F.lit("  - "), "field", F.lit(": "), was, F.lit(" → "), "to", F.lit(" ("), "at", F.lit(")"))
    return recent.join(named, "id").select("id", "label", "pos", line.alias("line"))


def targets_at_risk(cases: DataFrame, ctx: Context) -> DataFrame:
    """id, label, text: open incidents whose clock is breached or nearly so."""
    state = sla_state(ctx)
    left = format_remaining(state["remaining_ms"])
    text = F.when(state["breached"], F.concat(F.lit("breached "), left)).otherwise(F.concat(left, F.lit(" left ("), state["phase"], F.lit(")")))
    rows = incidents(_present(cases)).where(~is_terminal(ctx) & at_risk(state))
    return rows.select("id", _label().alias("label"), text.alias("text"))


def blocked(cases: DataFrame) -> DataFrame:
    """id, label, assignees (joined by commas) of blocked cases."""
    rows = _present(cases).where(F.col("status") == "blocked")
    return rows.select("id", _label().alias("label"), F.array_join("assignees", ", ").alias("assignees"))


def handover(cases: DataFrame, activity: DataFrame, ctx: Context, now_text: str, hours: int = HANDOVER_HOURS) -> DataFrame:
    """part, sort keys and line: the whole handover note, a row for each line, in order."""
    head = ("# Shift handover", "", f"Generated {now_text} · window {hours}h · this note is overwritten on every run.", "")
    names = ("## Open incidents", f"## Changed in the last {hours}h", "## Response/resolution targets at risk", "## Blocked")
    none = ("None.", "Nothing recorded.", "None.", "None.")
    spark: SparkSession = cases.sparkSession
    sev_rank = rank(ctx.severities, F.col("severity"), 99)
    wide = ("description", "comments", "activity", "custom_fields", "time_logs", "attack", "tags")
    cases = checkpoint(_present(cases).drop(*wide))  # read by each part below
    opened = checkpoint(open_incidents(cases, latest_activity(activity), ctx))
    shape = lambda part, sub, label, case, kind, n, line: [F.lit(part).alias("part"), sub.alias("sub"), (F.col(label) if isinstance(label, str) else label).alias("label"), case.alias("case_id"), F.lit(kind).alias("kind"), n.cast("int").alias("n"), line.alias("line")]
    blank, zero = F.lit(""), F.lit(0)
    lines = opened.select(*shape(1, sev_rank, "label", F.col("id"), 1, zero, F.col("line")))
    heads = opened.groupBy("severity", "severity_label").agg(F.min(sev_rank).alias("r"))
    lines = lines.union(heads.select(*shape(1, F.col("r"), blank, blank, 0, zero, F.concat(F.lit("### "), "severity_label"))))
    marks = ioc_lines(incidents(_present(cases)).where(~is_terminal(ctx)).select("id", "key", "title", "iocs"))
    marks = marks.join(opened.select("id", "severity", "label"), "id")
    lines = lines.union(marks.select(*shape(1, sev_rank, "label", F.col("id"), 2, F.col("pos"), F.col("line"))))
    changed = checkpoint(changed_in_window(cases, activity, ctx, hours))
    names_of = changed.select("id", "label").distinct()
    lines = lines.union(names_of.select(*shape(2, zero, "label", F.col("id"), 0, zero, F.concat(F.lit("- "), "label", F.lit(":")))))
    lines = lines.union(changed.select(*shape(2, zero, "label", F.col("id"), 1, F.col("pos"), F.col("line"))))
    risky = targets_at_risk(cases, ctx).join(opened.select("id", "severity"), "id")
    lines = lines.union(risky.select(*shape(3, sev_rank, "label", F.col("id"), 0, zero, F.concat(F.lit("- "), "label", F.lit(" — "), "text"))))
    stuck = blocked(cases)
    who = F.when(F.col("assignees") != "", F.concat(F.lit(" · "), "assignees")).otherwise("")
    lines = lines.union(stuck.select(*shape(4, zero, "label", F.col("id"), 0, zero, F.concat(F.lit("- "), "label", who))))
    fixed = [(0, i, x) for i, x in enumerate(head)]
    fixed += [(p, i - 3, x) for p, name in enumerate(names, 1) for i, x in enumerate((name, ""))]
    fixed += [(p, 1000, "") for p in range(1, 5)]
    frame = spark.createDataFrame(fixed, "part int, sub int, line string")
    lines = lines.union(frame.select("part", "sub", blank.alias("label"), blank.alias("case_id"), zero.alias("kind"), zero.alias("n"), "line"))
    empty = spark.createDataFrame([(p, x) for p, x in enumerate(none, 1)], "part int, line string")
    filled = lines.where("sub >= 0 and sub < 1000 and part > 0").select("part").distinct()
    empty = empty.join(filled, "part", "left_anti")
    lines = lines.union(empty.select("part", zero.alias("sub"), blank.alias("label"), blank.alias("case_id"), zero.alias("kind"), zero.alias("n"), "line"))
    return lines.orderBy("part", "sub", F.collate("label", "UNICODE"), "case_id", "kind", "n")


def write_handover(lines: DataFrame, path: str) -> None:
    """Overwrites the note: one file, as one person reads it."""
    lines.select("line").coalesce(1).write.mode("overwrite").text(path)


# Notices.


def due_notices(cases: DataFrame, ctx: Context, lead: int = LEAD_DAYS) -> DataFrame:
    """id, due_d, kind: open cases that are overdue or due within `lead` days. Archived ones count here."""
    today = ctx.today_col
    kind = F.when(F.col("due_d") < today, "overdue").when(F.col("due_d") <= F.date_add(today, lead), "soon")
    return cases.where(~is_terminal(ctx)).select("id", "due_d", kind.alias("kind")).where("kind is not null")


def breach_notices(cases: DataFrame, activity: DataFrame, ctx: Context) -> DataFrame:
    """id, phase: breached clocks of open cases that aren't archived and that no activity row tells of yet."""
    rows = _present(cases).where(~is_terminal(ctx)).select("id", sla_state(ctx).alias("s")).where("s.breached and not s.done")
    told = activity.where(F.col("field") == "sla").select("id", F.col("to").alias("told")).distinct()
    rows = rows.select("id", "s.phase", F.concat(F.lit("breached-"), "s.phase").alias("told"))
    return rows.join(told, ["id", "told"], "left_anti").select("id", "phase")


def close_guard(cases: DataFrame, new_status: Column, ctx: Context) -> DataFrame:
    """Incidents without a verdict that would be closed."""
    return incidents(cases).where((F.col("verdict") == "") & is_terminal(ctx, new_status))
