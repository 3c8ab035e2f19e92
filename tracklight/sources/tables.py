"""The driver's parquet tables, and the cases derived from them.

An order is a case: everything about it is arithmetic on its key, so that the same cases can be written down in
SQL (see `CASES_SQL`). Joins that only some columns need are made only when asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklight.model import Context

#: 2001-08-02 12:00:00 UTC, a Thursday.
NOW = 996_753_600_000
TODAY = "2001-08-02"
CONTEXT = Context(today=TODAY, now=NOW, me="Customer#000000001")

MINUTE = 60_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _iso(ms: str) -> str:
    return f"coalesce(date_format(timestamp_millis({ms}), \"{_ISO}\"), '')"


def _pick(index: str, *values: str) -> str:
    return f"element_at(array({', '.join(repr(v) for v in values)}), cast({index} as int) + 1)"


def cases(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    """Cases of the orders. parts: assignees (joins customers), tags (joins line items)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    k = "k"
    base = orders.withColumnRenamed("o_orderkey", "k").selectExpr(
        "*",
        f"{NOW} - (k * 7919) % 20160 * {MINUTE} AS created_ms",
        f"""CASE o_orderstatus WHEN 'F' THEN if(k % 5 = 0, 'cancelled', 'done') WHEN 'O' THEN if(k % 3 = 0, 'in-progress', 'todo')
            ELSE if(k % 3 = 0, 'blocked', 'review') END AS status""",
        "CASE WHEN k < 8 THEN 'epic' WHEN k % 2 = 0 THEN 'incident' ELSE 'task' END AS issue_type",
    ).selectExpr(
        "*",
        f"CASE WHEN o_orderstatus = 'F' OR k % 4 = 0 THEN created_ms + (k * 31) % 600 * {MINUTE} END AS responded_ms",
        f"CASE WHEN o_orderstatus = 'F' AND k % 3 <> 0 THEN created_ms + (k * 47) % 3000 * {MINUTE} END AS contained_ms",
        f"CASE WHEN o_orderstatus = 'F' THEN created_ms + (k * 61) % 6000 * {MINUTE} END AS resolved_ms",
        "cast(timestamp_millis(created_ms) AS date) AS created_d",
    )
    out = base.selectExpr(
        f"concat('P', cast({k} % 10 AS string)) AS project_id",
        "cast(k AS string) AS id",
        "concat('SOC-', cast(k AS string)) AS key",
        """CASE WHEN k % 9 = 0 THEN concat('OPS-', cast(k % 400 AS string), ': ', issue_type, ' ', cast(k AS string))
           ELSE concat('Case ', cast(k AS string), ' ', o_orderpriority) END AS title""",
        "CASE WHEN k % 17 = 0 THEN 'milestone' WHEN k >= 8 THEN 'subtask' ELSE 'task' END AS type",
        "issue_type",
        "status",
        f"{_pick('k % 4', 'critical', 'high', 'medium', 'low')} AS priority",
        "CASE WHEN k % 19 = 0 THEN '' ELSE concat('sev', substr(o_orderpriority, 1, 1)) END AS severity",
        f"CASE WHEN o_orderstatus = 'F' THEN {_pick('k % 5', '', 'true-positive', 'false-positive', 'security-testing', 'anomalous-safe')} ELSE '' END AS verdict",
        f"{_pick('k % 6', 'today', 'this-week', 'next', 'later', 'someday', 'none')} AS bucket",
        "created_d AS start_d",
        "CASE WHEN k % 7 <> 0 THEN date_add(created_d, cast(k % 30 AS int)) END AS due_d",
        "CASE WHEN o_orderstatus = 'F' THEN cast(timestamp_millis(resolved_ms) AS date) END AS completed_d",
        "cast(k % 5 * 25 AS double) AS progress",
        "created_ms",
        "created_ms AS detected_ms",
        "responded_ms",
        "contained_ms",
        "resolved_ms",
        f"{_iso('created_ms')} AS created_at",
        f"{_iso('created_ms')} AS detected_at",
        f"{_iso('responded_ms')} AS responded_at",
        f"{_iso('contained_ms')} AS contained_at",
        f"{_iso('resolved_ms')} AS resolved_at",
        "CASE WHEN k % 10 = 0 OR k = 0 THEN slice(array(''), 1, 0) ELSE array(cast(k - 1 AS string)) END AS dependencies",
        """array(named_struct('type', 'ip', 'value', concat('10.', cast(k % 200 AS string), '.', cast(k % 7 AS string), '.1'), 'note', ''),
                 named_struct('type', 'domain', 'value', concat('host', cast(k % 50 AS string), '.example.com'), 'note', 'seen')) AS iocs""",
        "cast(k % 8 AS double) AS time_estimate",
        "array(named_struct('date', '2001-08-01', 'hours', cast(k % 5 AS double), 'note', ''), named_struct('date', '2001-08-02', 'hours', 1.5D, 'note', '')) AS time_logs",
        "CASE WHEN k < 8 THEN '' ELSE cast(cast(floor(k / 8) AS bigint) AS string) END AS parent_id",
        "cast(k AS int) AS ord",
        "k AS tree_pos",
        "k % 13 = 0 AS archived",
        "k % 101 = 5 AS collapsed",
        "k",
        "o_custkey",
    )
    out = out.withColumns({t: F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.lit("")) for t, d in (("start", "start_d"), ("due", "due_d"), ("completed", "completed_d"))})
    none = F.expr("slice(array(''), 1, 0)")
    if "assignees" in parts:
        names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
        out = out.join(names, "o_custkey", "left")
        out = out.withColumn("assignees", F.when(F.col("c_name").isNull() | (F.col("k") % 11 == 0), none).otherwise(F.array("c_name"))).drop("c_name")
    else:
        out = out.withColumn("assignees", none)
    if "tags" in parts:
        lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.explode(F.array("l_returnflag", "l_linestatus")).alias("tag"))
        tags = lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
        out = out.join(tags, "k", "left").withColumn("tags", F.coalesce("tags", none))
    else:
        out = out.withColumn("tags", none)
    return out.drop("o_custkey")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes of the events: id (the user's), pos, at, at_ms, field, from, to.

    The events' clock is moved so that they end where NOW is.
    """
    shift = "1706745600000"  # 2024-02-01
    rows = table(spark, sf_dir, "events").selectExpr(
        "cast(user_id AS string) AS id",
        "event_id AS pos",
        f"unix_millis(cast(ts AS timestamp)) - {shift} + {NOW} AS at_ms",
        "CASE event_type WHEN 'click' THEN 'in-progress' WHEN 'error' THEN 'blocked' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'todo' ELSE 'review' END AS to",
        f"lag(CASE event_type WHEN 'click' THEN 'in-progress' WHEN 'error' THEN 'blocked' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'todo' ELSE 'review' END, 1, 'todo') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from",
    )
    return rows.select("id", "pos", F.date_format(F.timestamp_millis("at_ms"), _ISO).alias("at"), "at_ms", F.lit("status").alias("field"), "from", "to")
