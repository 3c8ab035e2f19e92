"""The operators applied to the driver's tables, each with the same in DuckDB SQL (tracklight/oracle.py)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklight.functions import dates, ioc, reputation, sla, text, timeline
from tracklight.model import PRIORITIES, is_terminal, label, rank, status_rank
from tracklight.operators import capture, catalogs, imports, predicates, reports, schedule, tree
from tracklight.operators.predicates import Filter
from tracklight.sources import projects as project_notes
from tracklight.sources import vault
from tracklight.sources.tables import CONTEXT as CTX
from tracklight.sources.tables import activity, cases, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NOW_TEXT = "2001-08-02T12:00:00Z"


def query(name: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return add


def _filter(name: str, wanted: str | Filter, *parts: str) -> None:
    chosen = Filter(text=wanted, show_archived=True) if isinstance(wanted, str) else wanted

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return predicates.search(cases(spark, sf_dir, *parts), chosen, CTX).select("id")

    run.__doc__ = f"Ids of the cases that {wanted!r} lets through."
    QUERIES[name] = run


_filter("filter_key_prefix", "key:SOC-12")
_filter("filter_status", "status:!done")
_filter("filter_type", "type:incident")
_filter("filter_severity_rank", "sev:>=sev2")
_filter("filter_severity_label", "severity:<medium")
_filter("filter_priority_rank", "prio:>=high")
_filter("filter_verdict", "verdict:false-positive")
_filter("filter_bucket", "bucket:!this-week")
_filter("filter_assignee_me", "assignee:me", "assignees")
_filter("filter_assignee_none", "assignee:none", "assignees")
_filter("filter_tag_neg", "tag:!r", "tags")
_filter("filter_progress_cmp", "progress:>=50 progress:<100")
for _word in ("overdue", "today", "tomorrow", "this-week", "this-month", "none"):
    _filter(f"filter_due_keyword_{_word.replace('-', '_')}", f"due:{_word}")
_filter("filter_due_relative", "due:<=2w due:>1d")
_filter("filter_due_not", "due:!2001-08-05")
_filter("filter_archived", "archived:true")
for _word in ("breached", "warn", "ok", "none"):
    _filter(f"filter_sla_{_word}", f"sla:{_word}")
_filter("filter_ioc", "ioc:host7[.]example")
_filter("filter_free_text", "2-high", "assignees", "tags")
_filter(
    "filter_structured",
    Filter(text="type:incident", statuses=("todo", "in-progress"), severities=("sev1", "sev2", "sev3"), tags=("N",), due="overdue"),
    "tags",
)


@query("match_count")
def match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.match_count(cases(spark, sf_dir), Filter(text="type:incident sev:>=high"), CTX)


@query("picker_search")
def picker_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).where(predicates.all_words("soc-1 urgent", "key", "title")).select("id")


@query("fuzzy_notes")
def fuzzy_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight nearest customers' names."""
    rows = table(spark, sf_dir, "customer").select("c_name", F.round(predicates.note_score(F.col("c_name"), "Customer#0000001"), 6).alias("score"))
    return rows.orderBy("score", "c_name").limit(8)


def _sort(key: str, descending: bool, *parts: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """pos of each case among its siblings."""
        rows = cases(spark, sf_dir, *parts)
        w = Window.partitionBy("parent_id").orderBy(*tree.sort_columns(key, CTX, descending), "tree_pos")
        return rows.select("id", F.row_number().over(w).cast("long").alias("pos"))

    QUERIES[f"sort_rank_{key}"] = run


for _key, _desc in (("title", False), ("status", True), ("severity", False), ("due", True), ("progress", True), ("sla", False)):
    _sort(_key, _desc)
_sort("assignees", False, "assignees")


@query("sla_state")
def sla_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sla.sla_state(CTX)
    rows = cases(spark, sf_dir).select("id", s.alias("s")).where("s is not null")
    return rows.select("id", "s.phase", "s.deadline_ms", "s.remaining_ms", "s.breached", "s.done", sla.at_risk(F.col("s")).alias("at_risk"))


@query("sla_chip")
def sla_chip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir).select("id", sla.chip(sla.sla_state(CTX)).alias("c")).where("c is not null")
    return rows.select("id", F.col("c.text").alias("chip"), "c.warn", "c.breach", "c.live")


@query("opened_closed_per_week")
def opened_closed_per_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.opened_closed_per_week(cases(spark, sf_dir), 8, CTX)


@query("time_in_status")
def time_in_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = activity(spark, sf_dir)
    return reports.time_in_status(cases(spark, sf_dir), moves, CTX)


@query("verdict_breakdown")
def verdict_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.verdict_breakdown(cases(spark, sf_dir)).withColumnRenamed("count", "n")


@query("sla_compliance")
def sla_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sla_compliance(cases(spark, sf_dir), CTX)


@query("lifecycle_durations")
def lifecycle_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.lifecycle_durations(cases(spark, sf_dir))
    return out.select("phase", F.coalesce("severity", F.lit("all")).alias("severity"), "n", F.round("mean_ms", 3).alias("mean_ms"), "median_ms")


@query("report_summary")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_summary(cases(spark, sf_dir), CTX)


@query("open_by_severity")
def open_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.open_by_severity(cases(spark, sf_dir), CTX).withColumnRenamed("count", "n")


@query("project_progress")
def project_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.project_progress(cases(spark, sf_dir), CTX)


@query("subtask_progress")
def subtask_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.subtask_progress(cases(spark, sf_dir), CTX)


@query("logged_hours")
def logged_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.logged_hours(cases(spark, sf_dir))


@query("latest_activity")
def latest_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.latest_activity(activity(spark, sf_dir))
    return rows.select("id", "at", F.col("from").alias("from_status"), F.col("to").alias("to_status"))


@query("distinct_assignees")
def distinct_assignees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distinct_values(cases(spark, sf_dir, "assignees"), "assignees", ("Nobody yet",))


@query("distinct_tags")
def distinct_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distinct_values(cases(spark, sf_dir, "tags"), "tags")


@query("wip_counts")
def wip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.wip_counts(cases(spark, sf_dir), CTX, {"in-progress": 1000, "review": 50}, F.col("severity")).withColumnRenamed("count", "n")


@query("backlog_buckets")
def backlog_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.backlog(cases(spark, sf_dir)).withColumnRenamed("count", "n")


def _lanes(by: str, *parts: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = cases(spark, sf_dir, *parts)
        epics = tree.nearest_epic(rows) if by == "epic" else None
        out = reports.lanes(rows, by, CTX, epics)
        return out.select("lane_key", "lane_label", F.col("lane_pos").cast("long").alias("lane_pos"), F.col("count").alias("n"))

    QUERIES[f"lanes_{by}"] = run


for _by in ("none", "epic", "severity", "bucket"):
    _lanes(_by)
_lanes("assignee", "assignees")


@query("timeline_extent")
def timeline_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.timeline_extent(cases(spark, sf_dir), CTX)


@query("key_prefix")
def key_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.key_prefix(cases(spark, sf_dir)).withColumnRenamed("count", "n")


@query("handover_open_incidents")
def handover_open_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir)
    latest = reports.latest_activity(activity(spark, sf_dir))
    return reports.open_incidents(rows, latest, CTX).select("id", "severity_label", "line")


@query("changed_in_window")
def changed_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.changed_in_window(cases(spark, sf_dir), activity(spark, sf_dir), CTX, hours=60).select("id", "pos", "line")


@query("targets_at_risk")
def targets_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.targets_at_risk(cases(spark, sf_dir), CTX).select("id", F.col("text").alias("risk"))


@query("blocked")
def blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.blocked(cases(spark, sf_dir, "assignees"))


@query("handover_note")
def handover_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole note's lines, counted by part and text."""
    rows = cases(spark, sf_dir, "assignees")
    return reports.handover(rows, activity(spark, sf_dir), CTX, NOW_TEXT, hours=60).select("part", "line")


@query("tree_flatten")
def tree_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tree.flatten(cases(spark, sf_dir))
    return out.select("id", F.col("depth").cast("long").alias("depth"), "path", "visible")


def _some() -> Column:
    return ~F.col("status").isin("cancelled", "review")


@query("tree_filter_strict")
def tree_filter_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.filter_strict(cases(spark, sf_dir), _some()).select("id", F.col("depth").cast("long").alias("depth"))


@query("tree_filter_promote")
def tree_filter_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.filter_promote(cases(spark, sf_dir), _some())


@query("archived_prune")
def archived_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.prune_archived(cases(spark, sf_dir)).select("id")


@query("tree_sorted_rows")
def tree_sorted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tree.sorted_rows(cases(spark, sf_dir), "due", CTX, _some(), descending=True)
    return out.select("id", F.col("depth").cast("long").alias("depth"), "path")


@query("tree_sorted_rows_unfiltered")
def tree_sorted_rows_unfiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tree.sorted_rows(cases(spark, sf_dir), "severity", CTX)
    return out.select("id", F.col("depth").cast("long").alias("depth"), "path")


@query("window_rows")
def window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a window, a limit by design."""
    return tree.window_rows(tree.flatten(cases(spark, sf_dir)).where("visible"), 100, 20).select("id")


@query("epic_ancestor")
def epic_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.nearest_epic(cases(spark, sf_dir))


@query("parent_lookup")
def parent_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.with_parent(cases(spark, sf_dir)).select("id", "parent_key", "parent_title")


@query("parent_candidates")
def parent_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.parent_candidates(cases(spark, sf_dir), "9", "3").select("id")


@query("tree_delete")
def tree_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.delete(cases(spark, sf_dir), "1", "17").select("id", "parent_id")


@query("tree_move")
def tree_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.move(cases(spark, sf_dir), "10", "2").select("id", "parent_id", F.col("ord").cast("long").alias("ord"))


@query("tree_reorder")
def tree_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.reorder(cases(spark, sf_dir), "5", "2").select("id", F.col("ord").cast("long").alias("ord"))


@query("tree_clone")
def tree_clone(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir).withColumns({"file_path": F.concat(F.lit("Cases/"), "id"), "collapsed": F.lit(True)})
    copy = tree.clone(rows, "9", lambda x: F.concat(F.lit("c"), x), NOW_TEXT)
    return copy.select("id", "parent_id", "key", "verdict", F.array_join("dependencies", ",").alias("deps"), "collapsed", "completed", "file_path")


@query("collapsed_overlay")
def collapsed_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir)
    recorded = rows.where(F.ascii(F.right("project_id", F.lit(1))) % 2 == 0)
    states = recorded.groupBy("project_id").agg(F.collect_list(F.when(F.col("k") % 5 == 1, F.col("id"))).alias("ids"))
    return tree.overlay_collapsed(rows, states).select("id", "collapsed")


@query("link_targets")
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = F.concat(F.lit("[[Notes/"), "p_name", F.when(F.col("p_partkey") % 2 == 0, "#part|shown").otherwise(""), F.lit("]]"))
    return table(spark, sf_dir, "part").select("p_partkey", text.link_target(link).alias("target"), text.link_name(link).alias("shown"))


@query("prune_settings")
def prune_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), "n_nationkey")
    return capture.prune_settings(kept, kept.where("n_nationkey % 4 <> 1").select("path"))


@query("nested_cards")
def nested_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir).withColumn("lane", F.lit("all"))
    path = tree.flatten(rows).select("id", "path")
    rows = rows.join(path, "id")
    return rows.select("id", tree.is_nested_card(["path"]).alias("nested"))


@query("schedule_patches")
def schedule_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.schedule(cases(spark, sf_dir), CTX)[0]


@query("schedule_scope")
def schedule_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.downstream(cases(spark, sf_dir), "13")


@query("would_create_cycle")
def would_create_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir)
    asked = [("13", "16"), ("16", "13"), ("13", "21"), ("5", "5")]
    return spark.createDataFrame([(a, b, schedule.would_create_cycle(rows, a, b)) for a, b in asked], "source string, target string, cycle boolean")


@query("dependency_arrows")
def dependency_arrows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.arrows(cases(spark, sf_dir), F.col("status") != "cancelled")


def _fangs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators written in several defanged ways."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    n = F.col("page_id") % 4
    value = (
        F.when(n == 0, F.regexp_replace(F.regexp_replace("url", "^http", "hxxp"), r"\.", "[.]"))
        .when(n == 1, F.concat(F.lit(" user(at)"), F.regexp_replace(F.regexp_extract("url", "//([^/?#]+)", 1), r"\.", "(.)")))
        .when(n == 2, F.md5("url"))
        .otherwise(F.concat(F.lit("10[.]"), (F.col("page_id") % 250).cast("string"), F.lit("[.]0[.]1 ")))
    )
    return pages.select("page_id", value.alias("value"))


@query("ioc_refang")
def ioc_refang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fangs(spark, sf_dir).select("page_id", ioc.refang("value").alias("refanged"))


@query("ioc_defang")
def ioc_defang(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fangs(spark, sf_dir).select("page_id", ioc.refang("value").alias("v"))
    return rows.select("page_id", ioc.defang("v", ioc.classify("v")).alias("defanged"))


@query("ioc_classify")
def ioc_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fangs(spark, sf_dir).select("page_id", ioc.classify(ioc.refang("value")).alias("kind"))


@query("ioc_paste")
def ioc_paste(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fangs(spark, sf_dir).groupBy((F.col("page_id") % 50).alias("pack")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "value"))), lambda x: x["value"]), ", ").alias("paste")
    )
    found = rows.select("pack", F.posexplode(ioc.parse_paste("paste", F.array(F.lit("10.3.0.1")))).alias("pos", "i"))
    return found.select("pack", F.col("pos").cast("long").alias("pos"), "i.type", "i.value")


def _extract(name: str, source: str, key: str, column: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source).select(key, F.posexplode(ioc.extract(column)).alias("pos", "i"))
        return rows.select(key, F.col("pos").cast("long").alias("pos"), "i.type", "i.value")

    QUERIES[name] = run


_extract("ioc_extract_documents", "documents", "doc_id", "text")
_extract("ioc_extract_pages", "pages", "page_id", "html")


@query("indicator_search")
def indicator_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of all projects with an indicator."""
    rows = cases(spark, sf_dir).select("project_id", "id", F.explode("iocs").alias("i"))
    hit = F.contains(F.lower(ioc.refang(F.col("i.value"))), F.lower(ioc.refang(F.lit("10[.]77[.]"))))
    return rows.where(hit).select("project_id", "id", F.col("i.value").alias("value"), ioc.ioc_line(F.col("i")).alias("line"))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id")
    n = F.col("event_id")
    s = lambda x: x.cast("string")
    stats = F.concat(
        F.lit('{"data":{"attributes":{"last_analysis_stats":{"malicious":'), s(n % 3), F.lit(',"suspicious":'), s(n % 2),
        F.lit(',"harmless":'), s(n % 60), F.lit(',"undetected":'), s(n % 5), F.lit("}}}}"),
    )
    score = F.concat(F.lit('{"data":{"abuseConfidenceScore":'), s(n % 101), F.lit(',"totalReports":'), s(n % 4), F.lit("}}"))
    provider = F.when(n % 2 == 0, "virustotal").otherwise("abuseipdb")
    status = F.when(n % 17 == 0, 429).when(n % 19 == 0, 404).when(n % 23 == 0, 403).when(n % 29 == 0, 500).otherwise(200)
    body = F.when(n % 31 == 0, "{oops").when(n % 37 == 0, "{}").when(n % 2 == 0, stats).otherwise(score)
    return rows.select("event_id", provider.alias("provider"), status.alias("status"), body.alias("body"))


@query("reputation_parse")
def reputation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _responses(spark, sf_dir)
    out = rows.select("event_id", reputation.outcome(F.col("provider"), F.col("status"), F.col("body")).alias("o"))
    return out.select("event_id", "o.verdict", "o.summary")


@query("reputation_requests")
def reputation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fangs(spark, sf_dir).select("page_id", ioc.refang("value").alias("v"))
    made = rows.select("page_id", F.explode(reputation.requests(ioc.classify("v"), F.col("v"))).alias("r"))
    return made.select("page_id", "r.provider", "r.queried", F.col("r.url").alias("request"))


@query("completion_outcome")
def completion_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("id", dates.completion_outcome().alias("outcome"))


@query("relative_due")
def relative_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("id", dates.relative_due(CTX).alias("due_text"))


@query("due_urgency")
def due_urgency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("id", dates.due_urgency(CTX).alias("urgency"))


@query("iso_week")
def iso_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.iso_week_label(F.col("o_orderdate").cast("date")).alias("week"))


@query("timeline_bars")
def timeline_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir).select("id", dates.bar(F.lit("2001-07-01").cast("date"), 12.0).alias("b")).where("b is not null")
    return rows.select("id", "b.x", "b.width", F.round("b.done_width", 6).alias("done_width"))


@query("milestones")
def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir).where("type = 'milestone'")
    return rows.select("id", F.coalesce("due_d", "start_d").alias("day"))


def _patches(rows: DataFrame) -> DataFrame:
    """Every third case patched: a new status, severity, due date and assignees."""
    k = F.col("k")
    return rows.where("k % 3 = 1").select(
        "id",
        F.when(k % 2 == 0, "done").otherwise("in-progress").alias("status"),
        F.when(k % 4 == 1, "sev1").alias("severity"),
        F.when(k % 5 == 1, "2001-08-20").alias("due"),
        F.when(k % 7 == 1, F.array(F.lit("Ann"), F.lit("Bo"))).alias("assignees"),
        F.when(k % 6 == 1, F.slice("iocs", 2, 1)).alias("iocs"),
    )


@query("activity_diff")
def activity_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir, "assignees")
    out = capture.activity_diff(rows, _patches(rows), NOW_TEXT)
    return out.select("id", F.col("pos").cast("long").alias("pos"), "field", F.col("from").alias("was"), F.col("to").alias("now_is"))


@query("completion_stamp")
def completion_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir)
    return capture.completion_stamp(rows, _patches(rows), CTX)


@query("lifecycle_stamp")
def lifecycle_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir)
    return capture.lifecycle_stamp(rows, _patches(rows), CTX, NOW_TEXT)


@query("ioc_diff")
def ioc_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir)
    patches = rows.select("id", F.when(F.col("k") % 2 == 0, F.slice("iocs", 1, 1)).otherwise(F.array(F.struct(F.lit("ip").alias("type"), F.lit("10.9.9.9").alias("value"), F.lit("").alias("note")))).alias("iocs"))
    out = capture.activity_diff(rows, patches, NOW_TEXT)
    return out.select("id", F.col("from").alias("was"), F.col("to").alias("now_is"))


@query("apply_patches")
def apply_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir, "assignees")
    out = capture.apply_patches(rows, _patches(rows), CTX, NOW_TEXT)
    return out.select("id", "status", "severity", "due", "completed", "responded_at", "resolved_at", F.array_join("assignees", ",").alias("who"))


@query("tree_diff")
def tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir).select("id", "status", "k")
    old = rows.where("k % 5 <> 0")
    new = rows.where("k % 7 <> 0").withColumn("status", F.when(F.col("k") % 3 == 0, "todo").otherwise(F.col("status")))
    return capture.tree_diff(old, new)


@query("assign_keys")
def assign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir).withColumn("key", F.when(F.col("k") % 4 == 0, "").otherwise(F.col("key")))
    return capture.assign_keys(rows, "INC", 100)


@query("adopt_keys")
def adopt_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir).withColumn("key", F.when(F.col("k") % 5 == 0, F.concat(F.lit("OPS-"), F.col("id"))).otherwise(""))
    return capture.adopt_keys(rows)


@query("embedded_key")
def embedded_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir).select("id", capture.embedded_key("title").alias("e")).where("e is not null")
    return rows.select("id", "e.prefix", "e.seq", F.col("e.title").alias("rest"))


@query("catalog_remap")
def catalog_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([("P3",), ("P4",)], "project_id string")
    return capture.remap_deleted(cases(spark, sf_dir), "status", "review", CTX, overriding=own).select("id", "status")


@query("type_coercion")
def type_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.coerce_type(cases(spark, sf_dir)).select("id", "type", "start", "progress", "parent_id")


@query("bulk_update")
def bulk_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = {"bucket": F.lit("today"), "tags": capture.add_value("tags", "bulk")}
    out = capture.update(cases(spark, sf_dir, "tags"), F.col("k") % 6 == 2, changes)
    return out.select("id", "bucket", F.array_join("tags", ",").alias("tags"))


@query("archive_move")
def archive_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.concat(F.lit("Cases/"), "project_id", F.lit("_tasks/"), "id", F.lit(".md"))
    nested = F.concat(F.lit("Cases/"), "project_id", F.lit("_tasks/"), (F.col("k") - 1).cast("string"), F.lit("/sub/"), "id", F.lit(".md"))
    rows = cases(spark, sf_dir).withColumn("file_path", F.when(F.col("k") % 9 == 5, nested).otherwise(own))
    return capture.archive(rows, rows.where("k % 9 = 4").select("id")).select("id", "file_path", "archived")


@query("dirty_merge")
def dirty_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("id"), F.when(F.col("event_type") == "signup", "full").otherwise("fm").alias("kind")
    )
    return capture.dirty(marks)


@query("recents")
def recents(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    out = capture.recents(opened, cases(spark, sf_dir))
    return out.select("id", "last_ms", F.col("pos").cast("long").alias("pos"))


@query("free_name")
def free_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = table(spark, sf_dir, "nation").select(
        F.when(F.col("n_nationkey") == 1, "Plan (copy)").otherwise(F.concat(F.lit("Plan (copy "), F.col("n_nationkey").cast("string"), F.lit(")"))).alias("name")
    )
    return capture.free_name(taken, "Plan")


@query("catalog_resolve")
def catalog_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir)
    default = spark.createDataFrame([(i, *s) for i, s in enumerate(CTX.statuses)], "ord int, id string, label string, complete boolean")
    own = spark.createDataFrame([("P1", 0, "open", "Open", False), ("P1", 1, "todo", "Queue", False), ("P1", 2, "done", "Shut", True)], "project_id string, ord int, id string, label string, complete boolean")
    used = rows.groupBy("project_id", F.when(F.col("k") % 77 == 5, "odd").otherwise(F.col("status")).alias("id")).agg(F.min("tree_pos").alias("first_pos"))
    out = catalogs.resolve(own, default, used)
    return out.select("project_id", F.col("pos").cast("long").alias("pos"), "id", "label", "complete")


@query("import_map")
def import_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign records of the parts."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    records = p.select(
        F.concat(F.lit("Notes/"), "p_name", F.lit(".md")).alias("path"),
        F.when(n % 3 == 0, F.col("p_name")).alias("title"),
        F.when(n % 4 == 0, "done").alias("status"),
        F.lit(None).cast("string").alias("priority"),
        F.lit("2001-08-01T10:00").alias("scheduled"),
        F.when(n % 2 == 0, "2001-08-09").alias("due"),
        F.lit(None).cast("string").alias("completed"),
        (n % 400).cast("double").alias("time_estimate"),
        F.array(F.lit("task"), F.lit("archived"), F.concat(F.lit("t"), (n % 5).cast("string"))).alias("tags"),
        F.when(n % 5 == 0, "FREQ=WEEKLY;INTERVAL=2").when(n % 5 == 1, "FREQ=DAILY").otherwise("RRULE:X").alias("recurrence"),
        (n % 6 == 0).alias("archived"),
        F.when(n % 7 == 0, "2001-07-01T08:00:00Z").alias("created"),
        F.when(n % 7 == 1, "2001-07-02T08:00:00Z").when(n % 7 == 2, "").alias("modified"),
    )
    out = imports.map_records(records, "task", "archived", now=NOW_TEXT)
    return out.select("path", "title", "status", "priority", "start", "due", F.array_join("tags", ",").alias("tags"), "recurrence.interval", "recurrence.every", "time_estimate", "archived", "created_at", "updated_at")


@query("notifier_due")
def notifier_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.due_notices(cases(spark, sf_dir), CTX)


@query("notifier_sla_breach")
def notifier_sla_breach(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir)
    told = rows.where("k % 6 = 0").select("id", F.lit("sla").alias("field"), F.lit("breached-response").alias("to"))
    return reports.breach_notices(rows, told, CTX)


@query("verdict_guard")
def verdict_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.close_guard(cases(spark, sf_dir), F.when(F.col("k") % 2 == 0, "done").otherwise("todo"), CTX).select("id")


@query("label_lookup")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = F.col("status"), F.col("priority")
    return cases(spark, sf_dir).select(
        "id", label(CTX.statuses, s).alias("status_label"), rank(CTX.statuses, s).cast("long").alias("status_rank"), label(PRIORITIES, p).alias("priority_label"), is_terminal(CTX).alias("terminal")
    )


@query("comment_preview")
def comment_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", text.preview(F.concat(F.lit("## "), "role", F.lit("\n**"), F.col("text"), F.lit("** `x` ![a](b) snake_case\n1. one"))).alias("preview"))


@query("name_functions")
def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat("p_name", F.lit(': "'), "p_type", F.lit('"/'), "p_brand")
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.slug(title).alias("slug"), text.initials("p_name").alias("initials"), text.initials("p_brand").alias("brand_initials"), text.truncate(title, 20).alias("short"), text.sanitize_name(title).alias("file_name")
    )


@query("project_path_layout")
def project_path_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("n_nationkey") % 3 == 0, F.concat("n_name", F.lit("/"), "n_name", F.lit(".md")))
    path = path.when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("root/Cases/"), "n_name", F.lit(".md"))).otherwise(F.concat(F.lit("Cases/"), "n_name", F.lit(".md")))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.task_folder(path).alias("folder"))


@query("yaml_round_trip")
def yaml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases written as notes and read back, healed into a forest again."""
    none = F.expr("slice(array(''), 1, 0)")
    rows = cases(spark, sf_dir, "assignees", "tags").withColumns(
        {
            "description": F.concat(F.lit('Line "one"\nand \\\\ two of '), "title"),
            "attack": none,
            "activity": F.array().cast("array<struct<at: string, field: string, `from`: string, `to`: string>>"),
            "comments": F.array(F.struct(F.lit("2001-08-01 10:00").alias("at"), F.concat(F.lit("seen\nby "), "id").alias("text"))),
            "recurrence": F.lit(None).cast("struct<interval: string, every: int, endDate: string>"),
            "custom_fields": F.create_map(F.lit("site"), F.col("project_id")),
            "updated_at": F.lit(NOW_TEXT),
            "file_path": F.concat(F.lit("Cases/"), "project_id", F.when(F.col("archived"), "/Archive/").otherwise("/"), "id", F.lit(".md")),
        }
    )
    notes = vault.render_notes(rows).withColumnRenamed("file_path", "path")
    back = vault.assemble(vault.parse_notes(notes))
    return back.select(
        "id", F.col("ord").cast("long").alias("ord"), "key", "title", "type", "status", "severity", "verdict", "due", "progress", "parent_id", "archived", "time_estimate",
        F.array_join("tags", ",").alias("tags"), F.array_join("dependencies", ",").alias("deps"), F.col("iocs")[1]["value"].alias("second_ioc"),
        F.col("comments")[0]["text"].alias("comment"), "description", F.element_at("custom_fields", "site").alias("site"),
    )


def _own_catalogs(rows: DataFrame) -> DataFrame:
    """Cases of projects of which P1 and P2 have their own statuses."""
    spark = rows.sparkSession
    default = spark.createDataFrame([(i, *s) for i, s in enumerate(CTX.statuses)], "ord int, id string, label string, complete boolean")
    own = [("P1", 0, "open", "Open", False), ("P1", 1, "todo", "Queue", False), ("P1", 2, "done", "Shut", True), ("P2", 0, "review", "Checked", True), ("P2", 1, "done", "Handed in", False)]
    catalog = catalogs.resolve(spark.createDataFrame(own, "project_id string, ord int, id string, label string, complete boolean"), default, catalogs.in_use(rows))
    return catalogs.attach(rows, catalog)


@query("own_catalog_progress")
def own_catalog_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.project_progress(_own_catalogs(cases(spark, sf_dir)), CTX.but(per_project=True))


@query("own_catalog_ranks")
def own_catalog_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = CTX.but(per_project=True)
    rows = _own_catalogs(cases(spark, sf_dir))
    return rows.select("id", status_rank(ctx).cast("long").alias("status_rank"), is_terminal(ctx).alias("terminal"), dates.due_urgency(ctx).alias("urgency"))


@query("own_catalog_stamps")
def own_catalog_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _own_catalogs(cases(spark, sf_dir))
    patches = rows.where("k % 2 = 0").select("id", F.when(F.col("k") % 4 == 0, "done").otherwise("review").alias("status"))
    return capture.apply_patches(rows, patches, CTX.but(per_project=True), NOW_TEXT).select("id", "status", "completed", "resolved_at")


@query("remap_logged")
def remap_logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deleted status that goes through the stamps and the log."""
    own = spark.createDataFrame([("P3",), ("P4",)], "project_id string")
    rows = cases(spark, sf_dir).withColumn("activity", F.array().cast(capture.ENTRY))
    out = capture.remap_deleted(rows, "status", "cancelled", CTX, overriding=own, at=NOW_TEXT)
    return out.select("id", "status", "completed", "responded_at", F.size("activity").cast("long").alias("entries"), F.get("activity", F.lit(0))["from"].alias("was"))


@query("adopt_stored_prefix")
def adopt_stored_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = spark.createDataFrame([("P1", "SEC"), ("P2", "")], "project_id string, key_prefix string")
    return capture.adopt_keys(cases(spark, sf_dir).withColumn("key", F.lit("")), stored=stored).select("id", F.split("key", "-")[0].alias("prefix"), "how")


@query("incident_templates")
def incident_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = cases(spark, sf_dir).where("issue_type = 'task'").select("id", "issue_type", "severity", "priority", "tags", F.lit("").alias("description"), "detected_at")
    out = capture.from_template(blank, "malware", NOW_TEXT)
    return out.select("id", "issue_type", "severity", "priority", F.array_join("tags", ",").alias("tags"), F.size(F.split("description", "\n- \\[ \\] ")).cast("long").alias("parts"), "detected_at")


@query("name_hue")
def name_hue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.hue("c_name").cast("long").alias("hue"))


@query("import_note")
def import_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("c_custkey") % 3 == 0, "---\npm-task: true\n---\n").when(F.col("c_custkey") % 3 == 1, "---\na: 1\n---\n").otherwise("")
    notes = table(spark, sf_dir, "customer").select(F.concat(F.lit("Notes/a/"), "c_name", F.lit(".md")).alias("path"), F.concat(mark, F.lit("Body of "), "c_name").alias("value"))
    return vault.import_note(notes)


@query("palette_upsert")
def palette_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    default = spark.createDataFrame([(i, s[0], s[1]) for i, s in enumerate(CTX.statuses)], "ord int, id string, label string")
    foreign = spark.createDataFrame([(0, "first", "First"), (1, "blocked", "Stuck"), (2, "wait", "Waiting")], "ord int, id string, label string")
    used = cases(spark, sf_dir).select(F.when(F.col("k") % 5 == 0, "odd").otherwise(F.col("status")).alias("id"))
    out = catalogs.upsert_palette(default, foreign, used)
    return out.select(F.col("ord").cast("long").alias("ord"), "id", "label")


def _timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n, origin, end of a timeline for each customer."""
    n = F.col("c_custkey").cast("int")
    rows = table(spark, sf_dir, "customer").select(n.alias("n"), F.date_add(F.lit("2000-11-03").cast("date"), n % 400).alias("origin"))
    return rows.withColumn("end", F.date_add("origin", F.col("n") % 120 + 1))


@query("timeline_weeks")
def timeline_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _timelines(spark, sf_dir)
    return rows.select("n", F.inline(timeline.weeks(F.col("origin"), F.col("end"), 24.0)))


@query("timeline_bands")
def timeline_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _timelines(spark, sf_dir)
    parts = [rows.select("n", F.lit(u).alias("unit"), F.inline(timeline.bands(F.col("origin"), F.col("end"), 8.0, u))) for u in ("month_year", "quarter", "year")]
    return parts[0].union(parts[1]).union(parts[2])


@query("timeline_snap")
def timeline_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _timelines(spark, sf_dir)
    points = {g: timeline.snap_points(F.col("origin"), F.col("end"), g, 10.0) for g in timeline.SNAPS}
    x = (F.col("n") % 900).cast("double")
    return rows.select("n", *(F.size(p).cast("long").alias(f"{g}_points") for g, p in points.items()), timeline.snap(x, points["month"], 25.0).alias("snapped"))


@query("local_input")
def local_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = timeline.local_input("created_at", "+05:30")
    return cases(spark, sf_dir).select("id", there.alias("there"), timeline.from_local_input(there, "+05:30").alias("back"))


@query("project_round_trip")
def project_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as projects with views and settings of their own, and read back."""
    n = F.col("n_nationkey")
    entry = "array<struct<id: string, label: string, color: string, icon: string>>"
    statuses = F.array(F.struct(F.lit("open").alias("id"), F.concat(F.lit('Open "'), "n_name", F.lit('"')).alias("label"), F.lit("#112233").alias("color"), F.lit("").alias("icon"), F.lit(True).alias("complete"), n.cast("double").alias("wip_limit")))
    config = F.struct(statuses.alias("statuses"), F.lit(None).cast(entry).alias("priorities"), F.lit(None).cast(entry).alias("issue_types"), F.lit("kanban").alias("default_view"), (n % 3 == 0).alias("auto_schedule"), F.lit(None).cast("boolean").alias("kanban_show_subtasks"), F.lit(None).cast("boolean").alias("kanban_show_description_preview"))
    made = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("P"), n.cast("string")).alias("id"), F.col("n_name").alias("title"), F.concat(F.lit('Two "lines"\nof '), "n_name").alias("description"), F.lit("#abcdef").alias("color"), F.lit("i").alias("icon"),
        F.lit("[]").alias("custom_fields"), F.array(F.lit("Ann"), F.col("n_name")).alias("team_members"), F.when(n % 2 == 0, "SOC").otherwise("").alias("key_prefix"), (n + 5).cast("long").alias("next_key_seq"),
        F.lit(NOW_TEXT).alias("created_at"), F.lit(NOW_TEXT).alias("updated_at"), F.concat(F.lit("Cases/"), "n_name", F.lit(".md")).alias("file_path"), F.lit(None).cast("array<string>").alias("task_ids"),
        F.lit(None).cast(f"array<{project_notes.VIEW}>").alias("saved_views"), F.when(n % 4 != 1, config).alias("config"),
    )
    made = project_notes.save_view(made, "P3", project_notes.make_view("v1", "Mine", Filter(text="type:incident", tags=("a", "b")), "due", True, "table"))
    rows = cases(spark, sf_dir).withColumn("parent_id", F.when(F.col("k") % 40 < 10, "").otherwise(F.col("parent_id"))).withColumn("file_path", F.concat(F.lit("T/"), "id", F.lit(".md")))
    notes = project_notes.render_projects(made, rows, CTX).withColumnRenamed("file_path", "path")
    back = project_notes.parse_projects(project_notes.discover(notes))
    view = F.get("saved_views", F.lit(0))
    return back.select(
        "id", "title", "description", "color", "key_prefix", "next_key_seq", F.array_join("team_members", ",").alias("team"), F.array_join("task_ids", ",").alias("roots"), view["name"].alias("view_name"),
        F.array_join(view["filter"]["tags"], ",").alias("view_tags"), view["sort_dir"].alias("view_dir"), F.get("config.statuses", F.lit(0))["label"].alias("status_label"),
        F.get("config.statuses", F.lit(0))["wip_limit"].alias("wip_limit"), F.col("config.auto_schedule").alias("auto_schedule"), "file_path",
    )


@query("embedded_tasks")
def embedded_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as old projects that hold their nations as cases, each with a case below it."""
    key = F.col("n_nationkey").cast("string")
    sub = F.struct(F.concat(F.lit("s"), key).alias("id"), F.lit("Sub").alias("title"), F.lit(True).alias("collapsed"))
    task = F.struct(F.col("n_nationkey"), F.concat(F.lit("n"), key).alias("id"), F.col("n_name").alias("title"), F.lit("blocked").alias("status"), F.array(sub).alias("subtasks"))
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(task)).alias("tasks"))
    region = F.col("n_regionkey").cast("string")
    value = F.concat(F.lit("---\npm-project: true\nid: R"), region, F.lit("\ntasks: "), F.to_json("tasks"), F.lit("\n---\n"))
    files = rows.select(value.alias("value"), F.concat(F.lit("R"), region, F.lit(".md")).alias("path"))
    out = project_notes.parse_embedded(project_notes.discover(files))
    return out.select("project_id", "id", "title", "status", "parent_id", F.col("ord").cast("long").alias("ord"), "collapsed")


@query("saved_view")
def saved_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that a project's saved view shows, once it was saved, updated and chosen by its id."""
    made = spark.createDataFrame([("P1",), ("P2",)], "id string").withColumn("saved_views", F.lit(None).cast(f"array<{project_notes.VIEW}>"))
    for v in ("v1", "v2"):
        made = project_notes.save_view(made, "P1", project_notes.make_view(v, v, Filter(text="type:incident")))
    made = project_notes.update_view(made, "P1", project_notes.make_view("v2", "", Filter(text="sev:>=high", statuses=("todo", "blocked")), "due", True))
    view = project_notes.select_view(project_notes.delete_view(made, "P1", "v1"), "P1", "v2")
    return project_notes.apply_view(cases(spark, sf_dir), view, CTX).select("id", F.lit(view["name"]).alias("view_name"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SLA compliance of the incidents of high severity whose clock is breached."""
    chosen = predicates.search(cases(spark, sf_dir), "type:incident sev:>=high sla:breached", CTX)
    return reports.sla_compliance(chosen, CTX)


QUERIES["flagship"] = flagship
