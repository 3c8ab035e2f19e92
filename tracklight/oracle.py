"""DuckDB SQL that says the same as each query of tracklight/queries.py, over the same derived cases."""

from __future__ import annotations

CASES = r"""
o AS (
  SELECT o_orderkey AS k, o_custkey, o_orderstatus AS os, o_orderpriority AS op,
    996753600000 - (o_orderkey * 7919) % 20160 * 60000 AS created_ms FROM orders),
o2 AS (
  SELECT *, CASE WHEN os = 'F' OR k % 4 = 0 THEN created_ms + (k * 31) % 600 * 60000 END AS responded_ms,
    CASE WHEN os = 'F' AND k % 3 <> 0 THEN created_ms + (k * 47) % 3000 * 60000 END AS contained_ms,
    CASE WHEN os = 'F' THEN created_ms + (k * 61) % 6000 * 60000 END AS resolved_ms,
    CAST(epoch_ms(created_ms) AS DATE) AS created_d,
    CASE WHEN k < 8 THEN 'epic' WHEN k % 2 = 0 THEN 'incident' ELSE 'task' END AS issue_type FROM o),
lt AS (
  SELECT k, list_sort(list(DISTINCT t)) AS tags FROM (
    SELECT l_orderkey AS k, l_returnflag AS t FROM lineitem UNION SELECT l_orderkey, l_linestatus FROM lineitem) GROUP BY k),
cases AS (
  SELECT 'P' || (k % 10) AS project_id, CAST(k AS VARCHAR) AS id, 'SOC-' || k AS key,
    CASE WHEN k % 9 = 0 THEN 'OPS-' || (k % 400) || ': ' || issue_type || ' ' || k ELSE 'Case ' || k || ' ' || op END AS title,
    CASE WHEN k % 17 = 0 THEN 'milestone' WHEN k >= 8 THEN 'subtask' ELSE 'task' END AS type, issue_type,
    CASE os WHEN 'F' THEN CASE WHEN k % 5 = 0 THEN 'cancelled' ELSE 'done' END WHEN 'O' THEN CASE WHEN k % 3 = 0 THEN 'in-progress' ELSE 'todo' END
      ELSE CASE WHEN k % 3 = 0 THEN 'blocked' ELSE 'review' END END AS status,
    ['critical', 'high', 'medium', 'low'][1 + k % 4] AS priority,
    CASE WHEN k % 19 = 0 THEN '' ELSE 'sev' || substr(op, 1, 1) END AS severity,
    CASE WHEN os = 'F' THEN ['', 'true-positive', 'false-positive', 'security-testing', 'anomalous-safe'][1 + k % 5] ELSE '' END AS verdict,
    ['today', 'this-week', 'next', 'later', 'someday', 'none'][1 + k % 6] AS bucket,
    created_d AS start_d, CASE WHEN k % 7 <> 0 THEN created_d + CAST(k % 30 AS INT) END AS due_d,
    CASE WHEN os = 'F' THEN CAST(epoch_ms(resolved_ms) AS DATE) END AS completed_d,
    CAST(k % 5 * 25 AS DOUBLE) AS progress, created_ms, created_ms AS detected_ms, responded_ms, contained_ms, resolved_ms,
    coalesce(strftime(epoch_ms(created_ms), '%Y-%m-%dT%H:%M:%SZ'), '') AS created_at,
    coalesce(strftime(epoch_ms(responded_ms), '%Y-%m-%dT%H:%M:%SZ'), '') AS responded_at,
    coalesce(strftime(epoch_ms(resolved_ms), '%Y-%m-%dT%H:%M:%SZ'), '') AS resolved_at,
    CASE WHEN k % 10 = 0 THEN CAST([] AS VARCHAR[]) ELSE [CAST(k - 1 AS VARCHAR)] END AS dependencies,
    ['10.' || (k % 200) || '.' || (k % 7) || '.1', 'host' || (k % 50) || '.example.com'] AS iocs,
    CAST(k % 8 AS DOUBLE) AS time_estimate, CAST(k % 5 AS DOUBLE) + 1.5 AS logged,
    CASE WHEN k < 8 THEN '' ELSE CAST(k // 8 AS VARCHAR) END AS parent_id, CAST(k AS INT) AS ord, k AS tree_pos,
    k % 13 = 0 AS archived, k % 101 = 5 AS collapsed, k,
    coalesce(strftime(created_d, '%Y-%m-%d'), '') AS start,
    CASE WHEN k % 7 <> 0 THEN strftime(created_d + CAST(k % 30 AS INT), '%Y-%m-%d') ELSE '' END AS due,
    CASE WHEN os = 'F' THEN strftime(epoch_ms(resolved_ms), '%Y-%m-%d') ELSE '' END AS completed,
    CASE WHEN c_name IS NULL OR k % 11 = 0 THEN CAST([] AS VARCHAR[]) ELSE [c_name] END AS assignees,
    coalesce(tags, CAST([] AS VARCHAR[])) AS tags
  FROM o2 LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN lt USING (k)),
statuses(pos, sid, slabel, term) AS (
  VALUES (0, 'todo', 'To Do', false), (1, 'in-progress', 'In Progress', false), (2, 'blocked', 'Blocked', false),
    (3, 'review', 'In Review', false), (4, 'done', 'Done', true), (5, 'cancelled', 'Cancelled', true)),
pol(severity, r, s) AS (VALUES ('sev1', 60, 240), ('sev2', 240, 1440), ('sev3', 1440, 4320), ('sev4', 2880, 10080)),
clock AS (
  SELECT id, CASE WHEN resolved_at = '' AND responded_at = '' THEN 'response' ELSE 'resolution' END AS phase,
    created_ms + (CASE WHEN resolved_at = '' AND responded_at = '' THEN r ELSE s END) * 60000 AS deadline_ms,
    (CASE WHEN resolved_at = '' AND responded_at = '' THEN r ELSE s END) * 60000 AS span_ms,
    coalesce(resolved_ms, 996753600000) AS upto, resolved_at <> '' AS done
  FROM cases JOIN pol USING (severity) WHERE issue_type = 'incident'),
sla AS (
  SELECT *, deadline_ms - upto AS remaining_ms, upto > deadline_ms AS breached,
    NOT done AND (upto > deadline_ms OR deadline_ms - upto < span_ms * 0.25) AS at_risk,
    CASE WHEN deadline_ms < upto THEN '+' ELSE '' END || CASE WHEN abs(deadline_ms - upto) // 60000 >= 60
      THEN (abs(deadline_ms - upto) // 3600000) || 'h ' || lpad(CAST(abs(deadline_ms - upto) // 60000 % 60 AS VARCHAR), 2, '0') || 'm'
      ELSE (abs(deadline_ms - upto) // 60000) || 'm' END AS left_text FROM clock),
bucketed AS (
  SELECT c.id, CASE WHEN s.id IS NULL THEN 'none' WHEN s.breached THEN 'breached' WHEN s.at_risk THEN 'warn' ELSE 'ok' END AS b
  FROM cases c LEFT JOIN sla s USING (id)),
ev AS (
  SELECT CAST(user_id AS VARCHAR) AS id, event_id AS pos, epoch_us(ts) // 1000 - 1706745600000 + 996753600000 AS at_ms,
    CASE event_type WHEN 'click' THEN 'in-progress' WHEN 'error' THEN 'blocked' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'todo' ELSE 'review' END AS t,
    ts FROM events),
activity AS (
  SELECT id, pos, at_ms, strftime(epoch_ms(at_ms), '%Y-%m-%dT%H:%M:%SZ') AS at_iso, lag(t, 1, 'todo') OVER (PARTITION BY id ORDER BY ts, pos) AS f, t FROM ev),
walk AS (
  SELECT id, 0 AS depth, lpad(CAST(ord AS VARCHAR), 10, '0') AS path, true AS visible, collapsed FROM cases WHERE parent_id = ''
  UNION ALL
  SELECT c.id, w.depth + 1, w.path || '/' || lpad(CAST(c.ord AS VARCHAR), 10, '0'), w.visible AND NOT w.collapsed, c.collapsed
  FROM walk w JOIN cases c ON c.parent_id = w.id)
"""


def _sql(rest: str) -> str:
    """A query over the derived cases; `rest` may begin with more tables after a comma."""
    return f"WITH RECURSIVE {CASES}{rest}"


def _where(condition: str) -> str:
    return _sql(f"SELECT id FROM cases WHERE {condition}")


_OPEN = "status NOT IN ('done', 'cancelled')"
_DUE = "DATE '2001-08-02'"
_LABEL = "CASE WHEN key <> '' THEN key || ' ' || title ELSE title END"

ORACLE_SQL: dict[str, str] = {
    "filter_key_prefix": _where("lower(key) = 'soc-12' OR starts_with(lower(key), 'soc-12-')"),
    "filter_status": _where("status <> 'done'"),
    "filter_type": _where("issue_type = 'incident'"),
    "filter_severity_rank": _where("severity IN ('sev1', 'sev2')"),
    "filter_severity_label": _where("severity IN ('sev4', 'sev5')"),
    "filter_priority_rank": _where("priority IN ('critical', 'high')"),
    "filter_verdict": _where("verdict = 'false-positive'"),
    "filter_bucket": _where("bucket <> 'this-week'"),
    "filter_assignee_me": _where("list_contains(assignees, 'Customer#000000001')"),
    "filter_assignee_none": _where("len(assignees) = 0"),
    "filter_tag_neg": _where("NOT list_contains(tags, 'R')"),
    "filter_progress_cmp": _where("progress >= 50 AND progress < 100"),
    "filter_due_keyword_overdue": _where(f"due_d < {_DUE} AND {_OPEN}"),
    "filter_due_keyword_today": _where(f"due_d = {_DUE}"),
    "filter_due_keyword_tomorrow": _where(f"due_d = {_DUE} + 1"),
    "filter_due_keyword_this_week": _where(f"due_d BETWEEN {_DUE} AND DATE '2001-08-05'"),
    "filter_due_keyword_this_month": _where(f"due_d >= {_DUE} AND due_d < DATE '2001-09-01'"),
    "filter_due_keyword_none": _where("due_d IS NULL"),
    "filter_due_relative": _where(f"due_d <= {_DUE} + 14 AND due_d > {_DUE} + 1"),
    "filter_due_not": _where("due_d <> DATE '2001-08-05'"),
    "filter_archived": _where("archived"),
    **{f"filter_sla_{b}": _sql(f"SELECT id FROM bucketed WHERE b = '{b}'") for b in ("breached", "warn", "ok", "none")},
    "filter_ioc": _where("len(list_filter(iocs, lambda v: contains(v, 'host7.example'))) > 0"),
    "filter_free_text": _where(
        "id = '2-high' OR contains(lower(key), '2-high') OR contains(lower(title), '2-high') OR contains(status, '2-high') OR "
        "len(list_filter(assignees || tags || iocs, lambda v: contains(lower(v), '2-high'))) > 0"
    ),
    "filter_structured": _where(
        "NOT archived AND issue_type = 'incident' AND status IN ('todo', 'in-progress') AND severity IN ('sev1', 'sev2', 'sev3') "
        f"AND list_contains(tags, 'N') AND due_d < {_DUE}"
    ),
    "match_count": _sql(
        "SELECT count(*) FILTER (NOT archived AND issue_type = 'incident' AND severity IN ('sev1', 'sev2')) AS matched, count(*) AS total FROM cases"
    ),
    "picker_search": _where("contains(lower(key || ' ' || title), 'soc-1') AND contains(lower(key || ' ' || title), 'urgent')"),
    "fuzzy_notes": """SELECT c_name, round(levenshtein(lower(c_name), 'customer#0000001')
      + CASE WHEN starts_with(lower(c_name), 'customer#0000001') THEN -10.0 WHEN contains(lower(c_name), 'customer#0000001') THEN -5.0 ELSE 0.0 END
      + length(c_name) * 0.01::DOUBLE, 6)::DOUBLE AS score FROM customer ORDER BY score, c_name LIMIT 8""",
    **{
        f"sort_rank_{key}": _sql(
            f"""SELECT c.id, row_number() OVER (PARTITION BY parent_id ORDER BY {order}, tree_pos) AS pos
            FROM cases c JOIN statuses ON sid = status LEFT JOIN sla s ON s.id = c.id"""
        )
        for key, order in {
            "title": "title",
            "status": "statuses.pos DESC",
            "severity": "CASE WHEN severity = '' THEN 999 ELSE CAST(substr(severity, 4) AS INT) END",
            "due": "CASE WHEN due = '' THEN 'zzz' ELSE due END DESC",
            "progress": "progress DESC",
            "sla": "CASE WHEN term OR coalesce(s.done, false) THEN 2 WHEN s.id IS NULL THEN 1 ELSE 0 END, "
            "CASE WHEN term OR coalesce(s.done, false) OR s.id IS NULL THEN 0 ELSE remaining_ms END",
            "assignees": "coalesce(assignees[1], '')",
        }.items()
    },
    "sla_state": _sql("SELECT id, phase, deadline_ms, remaining_ms, breached, done, at_risk FROM sla"),
    "sla_chip": _sql(
        """SELECT id, CASE WHEN done THEN 'Breached ' WHEN phase = 'response' THEN 'Respond ' ELSE 'Resolve ' END || left_text AS chip,
        NOT done AND NOT breached AND at_risk AS warn, breached AS breach, NOT done AS live FROM sla WHERE NOT done OR breached"""
    ),
    "opened_closed_per_week": _sql(
        """SELECT label, (SELECT count(*) FROM cases WHERE strftime(epoch_ms(created_ms), '%G-W%V') = label) AS opened,
        (SELECT count(*) FROM cases WHERE strftime(completed_d, '%G-W%V') = label) AS closed
        FROM (SELECT strftime(epoch_ms(996753600000 - n * 604800000), '%G-W%V') AS label FROM range(8) t(n))"""
    ),
    "time_in_status": _sql(
        """, span AS (SELECT id, status, created_ms AS s, coalesce(resolved_ms, 996753600000) AS e FROM cases),
        mv AS (SELECT a.*, s, e, least(greatest(s, at_ms), e) AS c FROM activity a JOIN span USING (id)),
        st AS (SELECT *, lag(c) OVER w AS b, lead(c) OVER w AS n FROM mv WINDOW w AS (PARTITION BY id ORDER BY at_ms, pos)),
        parts AS (
          SELECT f AS status, c - s AS ms FROM st WHERE b IS NULL UNION ALL SELECT t, coalesce(n, e) - c FROM st
          UNION ALL SELECT status, e - s FROM span WHERE id NOT IN (SELECT id FROM mv))
        SELECT status, CAST(sum(greatest(ms, 0)) AS BIGINT) AS total_ms FROM parts GROUP BY status"""
    ),
    "verdict_breakdown": _sql("SELECT verdict, count(*) AS n FROM cases WHERE issue_type = 'incident' GROUP BY verdict"),
    "sla_compliance": _sql(
        """SELECT CASE WHEN severity = '' THEN 'none' ELSE severity END AS severity, count(*) FILTER (done AND NOT breached) AS met,
        count(*) FILTER (done AND breached) AS breached, count(*) FILTER (s.id IS NULL) AS no_data, count(*) FILTER (NOT done) AS "open"
        FROM cases c LEFT JOIN sla s USING (id) WHERE issue_type = 'incident' GROUP BY 1"""
    ),
    "lifecycle_durations": _sql(
        """, d AS (
          SELECT CASE WHEN severity = '' THEN 'none' ELSE severity END AS sev, unnest(['respond', 'contain', 'resolve']) AS phase,
            unnest([responded_ms, contained_ms, resolved_ms]) - detected_ms AS ms FROM cases WHERE issue_type = 'incident')
        SELECT phase, coalesce(sev, 'all') AS severity, count(*) AS n, round(avg(ms), 3) AS mean_ms, median(ms) AS median_ms
        FROM d WHERE ms >= 0 GROUP BY GROUPING SETS ((phase), (phase, sev))"""
    ),
    "report_summary": _sql(
        f"""SELECT count(*) FILTER ({_OPEN}) AS "open", count(*) FILTER (issue_type = 'incident') AS incidents,
        count(*) FILTER (strftime(completed_d, '%G-W%V') = '2001-W31') AS closed_this_week,
        count(*) FILTER (issue_type = 'incident' AND verdict = 'true-positive') AS true_positives,
        CAST(round(100.0 * count(*) FILTER (done AND NOT breached) / nullif(count(*) FILTER (done), 0)) AS INT) AS sla_met_pct
        FROM cases LEFT JOIN sla USING (id)"""
    ),
    "open_by_severity": _sql(f"SELECT severity, count(*) AS n FROM cases WHERE issue_type = 'incident' AND {_OPEN} GROUP BY severity"),
    "project_progress": _sql(f"SELECT project_id, count(*) AS total, count(*) FILTER (NOT ({_OPEN})) AS done FROM cases GROUP BY 1"),
    "subtask_progress": _sql(
        f"SELECT parent_id AS id, count(*) AS total, count(*) FILTER (NOT ({_OPEN})) AS done FROM cases WHERE parent_id <> '' GROUP BY 1"
    ),
    "logged_hours": _sql(
        """SELECT id, logged, time_estimate > 0 AND logged > time_estimate AS over,
        CASE WHEN time_estimate > 0 THEN CAST(round(logged / time_estimate * 100) AS INT) END AS pct FROM cases"""
    ),
    "latest_activity": _sql(
        """SELECT id, at_iso AS "at", f AS from_status, t AS to_status FROM activity
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY at_iso DESC, pos) = 1"""
    ),
    "distinct_assignees": _sql("SELECT DISTINCT unnest(assignees) AS value FROM cases UNION SELECT 'Nobody yet'"),
    "distinct_tags": _sql("SELECT DISTINCT unnest(tags) AS value FROM cases"),
    "wip_counts": _sql(
        """SELECT severity AS lane, status, count(*) AS n,
        count(*) > CASE status WHEN 'in-progress' THEN 1000 WHEN 'review' THEN 50 ELSE 1000000000 END AS over FROM cases GROUP BY 1, 2"""
    ),
    "backlog_buckets": _sql(
        """SELECT bucket, CASE bucket WHEN 'today' THEN 'Today' WHEN 'this-week' THEN 'This week' WHEN 'next' THEN 'Next'
        WHEN 'later' THEN 'Later' WHEN 'someday' THEN 'Someday' ELSE 'No bucket' END AS label, count(*) AS n FROM cases GROUP BY 1"""
    ),
    "lanes_none": _sql("SELECT 'all' AS lane_key, '' AS lane_label, CAST(1 AS BIGINT) AS lane_pos, count(*) AS n FROM cases"),
    "lanes_epic": _sql(
        """, ep AS (
          SELECT id, '' AS epic_id, issue_type FROM cases WHERE parent_id = ''
          UNION ALL SELECT c.id, CASE WHEN e.issue_type = 'epic' THEN e.id ELSE e.epic_id END, c.issue_type FROM ep e JOIN cases c ON c.parent_id = e.id),
        l AS (
          SELECT ep.epic_id AS lane_key, coalesce(x.key || ' · ' || x.title, 'No epic') AS lane_label, count(*) AS n, min(c.tree_pos) AS f
          FROM ep JOIN cases c USING (id) LEFT JOIN cases x ON x.id = ep.epic_id GROUP BY 1, 2)
        SELECT lane_key, lane_label, row_number() OVER (ORDER BY lane_key = '', f, lane_key) AS lane_pos, n FROM l"""
    ),
    "lanes_assignee": _sql(
        """, l AS (SELECT coalesce(assignees[1], '') AS lane_key, count(*) AS n FROM cases GROUP BY 1)
        SELECT lane_key, CASE WHEN lane_key = '' THEN 'Unassigned' ELSE lane_key END AS lane_label,
        row_number() OVER (ORDER BY lane_key = '', lane_key) AS lane_pos, n FROM l"""
    ),
    "lanes_severity": _sql(
        """, l AS (SELECT severity AS lane_key, count(*) AS n FROM cases GROUP BY 1)
        SELECT lane_key, CASE lane_key WHEN '' THEN 'No severity' WHEN 'sev1' THEN 'Critical' WHEN 'sev2' THEN 'High' WHEN 'sev3' THEN 'Medium'
          WHEN 'sev4' THEN 'Low' ELSE 'Informational' END AS lane_label,
        row_number() OVER (ORDER BY lane_key = '', lane_key) AS lane_pos, n FROM l"""
    ),
    "lanes_bucket": _sql(
        """, b(p, lane_key, lane_label) AS (VALUES (0, 'today', 'Today'), (1, 'this-week', 'This week'), (2, 'next', 'Next'), (3, 'later', 'Later'),
          (4, 'someday', 'Someday'), (5, 'none', 'No bucket'))
        SELECT lane_key, lane_label, row_number() OVER (ORDER BY p) AS lane_pos, count(*) AS n FROM cases JOIN b ON lane_key = bucket GROUP BY p, lane_key, lane_label"""
    ),
    "timeline_extent": _sql(
        """, e AS (SELECT least(min(start_d), min(due_d), DATE '2001-08-02') - 7 AS lo, greatest(max(start_d), max(due_d), DATE '2001-08-02') + 14 AS hi FROM cases),
        x AS (SELECT lo, hi, CAST(greatest(ceil((90 - date_diff('day', lo, hi)) / 2), 0) AS INT) AS n FROM e)
        SELECT CAST(date_trunc('month', lo - n) AS DATE) AS first_day, hi + n AS last_day FROM x"""
    ),
    "key_prefix": _sql(
        """SELECT regexp_extract(title, '^([A-Z][A-Z0-9]+)-(\\d+):?\\s*', 1) AS prefix, count(*) AS n, min(tree_pos) AS first_pos
        FROM cases GROUP BY 1 HAVING prefix <> ''""".replace("\\\\", "\\")
    ),
    "handover_open_incidents": _sql(
        f""", last AS (SELECT * FROM activity QUALIFY row_number() OVER (PARTITION BY id ORDER BY at_iso DESC, pos) = 1)
        SELECT c.id, CASE severity WHEN '' THEN 'No severity' WHEN 'sev1' THEN 'Critical' WHEN 'sev2' THEN 'High' WHEN 'sev3' THEN 'Medium'
          WHEN 'sev4' THEN 'Low' ELSE 'Informational' END AS severity_label,
        '- ' || {_LABEL} || ' — ' || status || ' · ' || CASE WHEN s.id IS NULL THEN 'no target' WHEN breached THEN 'target breached ' || left_text
          ELSE phase || ' target in ' || left_text END || coalesce(' · last: status → ' || last.t || ' at ' || last.at_iso, '') AS line
        FROM cases c LEFT JOIN sla s USING (id) LEFT JOIN last ON last.id = c.id WHERE NOT archived AND issue_type = 'incident' AND {_OPEN}"""
    ),
    "changed_in_window": _sql(
        """SELECT c.id, a.pos, '  - status: ' || a.f || ' → ' || a.t || ' (' || a.at_iso || ')' AS line FROM activity a JOIN cases c USING (id)
        WHERE NOT archived AND 996753600000 - at_ms BETWEEN 0 AND 60 * 3600000"""
    ),
    "targets_at_risk": _sql(
        f"""SELECT c.id, CASE WHEN breached THEN 'breached ' || left_text ELSE left_text || ' left (' || phase || ')' END AS risk
        FROM cases c JOIN sla s USING (id) WHERE NOT archived AND {_OPEN} AND at_risk"""
    ),
    "blocked": _sql(f"SELECT id, {_LABEL} AS label, array_to_string(assignees, ', ') AS assignees FROM cases WHERE NOT archived AND status = 'blocked'"),
    "tree_flatten": _sql("SELECT id, CAST(depth AS BIGINT) AS depth, path, visible FROM walk"),
    "tree_filter_strict": _sql(
        """, w2 AS (
          SELECT id, 0 AS depth FROM cases WHERE parent_id = '' AND status NOT IN ('cancelled', 'review')
          UNION ALL SELECT c.id, w.depth + 1 FROM w2 w JOIN cases c ON c.parent_id = w.id WHERE status NOT IN ('cancelled', 'review'))
        SELECT id, CAST(depth AS BIGINT) AS depth FROM w2"""
    ),
    "tree_filter_promote": _sql(
        """, w2 AS (
          SELECT id, '' AS above, status NOT IN ('cancelled', 'review') AS kept, lpad(CAST(ord AS VARCHAR), 10, '0') AS path FROM cases WHERE parent_id = ''
          UNION ALL SELECT c.id, CASE WHEN w.kept THEN w.id ELSE w.above END, c.status NOT IN ('cancelled', 'review'),
            w.path || '/' || lpad(CAST(c.ord AS VARCHAR), 10, '0') FROM w2 w JOIN cases c ON c.parent_id = w.id)
        SELECT id, above AS parent_id, path FROM w2 WHERE kept"""
    ),
    "archived_prune": _sql(
        """, w2 AS (
          SELECT id FROM cases WHERE parent_id = '' AND NOT archived UNION ALL SELECT c.id FROM w2 w JOIN cases c ON c.parent_id = w.id WHERE NOT archived)
        SELECT id FROM w2"""
    ),
    "tree_sorted_rows": _sql(
        """, kept AS (SELECT * FROM cases WHERE status NOT IN ('cancelled', 'review')),
        up AS (SELECT k.* REPLACE (CASE WHEN p.id IS NULL THEN '' ELSE k.parent_id END AS parent_id) FROM kept k LEFT JOIN (SELECT id FROM kept) p ON p.id = k.parent_id),
        pl AS (SELECT id, parent_id, lpad(CAST(row_number() OVER (PARTITION BY parent_id ORDER BY CASE WHEN due = '' THEN 'zzz' ELSE due END DESC, ord, id) AS VARCHAR), 10, '0') AS p FROM up),
        w2 AS (SELECT id, 0 AS depth, p AS path FROM pl WHERE parent_id = ''
          UNION ALL SELECT c.id, w.depth + 1, w.path || '/' || c.p FROM w2 w JOIN pl c ON c.parent_id = w.id)
        SELECT id, CAST(depth AS BIGINT) AS depth, path FROM w2"""
    ),
    "tree_sorted_rows_unfiltered": _sql(
        """, pl AS (SELECT id, parent_id, collapsed, lpad(CAST(row_number() OVER (PARTITION BY parent_id ORDER BY
            CASE WHEN severity = '' THEN 999 ELSE CAST(substr(severity, 4) AS INT) END, ord, id) AS VARCHAR), 10, '0') AS p FROM cases),
        w2 AS (SELECT id, 0 AS depth, p AS path, collapsed FROM pl WHERE parent_id = ''
          UNION ALL SELECT c.id, w.depth + 1, w.path || '/' || c.p, c.collapsed FROM w2 w JOIN pl c ON c.parent_id = w.id WHERE NOT w.collapsed)
        SELECT id, CAST(depth AS BIGINT) AS depth, path FROM w2"""
    ),
    "window_rows": _sql("SELECT id FROM walk WHERE visible ORDER BY path LIMIT 36 OFFSET 92"),
    "epic_ancestor": _sql(
        """, ep AS (
          SELECT id, '' AS epic_id, issue_type FROM cases WHERE parent_id = ''
          UNION ALL SELECT c.id, CASE WHEN e.issue_type = 'epic' THEN e.id ELSE e.epic_id END, c.issue_type FROM ep e JOIN cases c ON c.parent_id = e.id)
        SELECT id, epic_id FROM ep"""
    ),
    "parent_lookup": _sql(
        "SELECT c.id, coalesce(p.key, '') AS parent_key, coalesce(p.title, '') AS parent_title FROM cases c LEFT JOIN cases p ON p.id = c.parent_id"
    ),
    "parent_candidates": _sql(
        """, w2 AS (SELECT id FROM cases WHERE id IN ('9', '3') UNION SELECT c.id FROM w2 w JOIN cases c ON c.parent_id = w.id)
        SELECT id FROM cases WHERE id NOT IN (SELECT id FROM w2)"""
    ),
    "tree_delete": _sql(
        """, w2 AS (SELECT id FROM cases WHERE id IN ('1', '17') UNION SELECT c.id FROM w2 w JOIN cases c ON c.parent_id = w.id)
        SELECT id, parent_id FROM cases WHERE id NOT IN (SELECT id FROM w2)"""
    ),
    "tree_move": _sql(
        """SELECT id, CASE WHEN id = '10' THEN '2' ELSE parent_id END AS parent_id,
        CAST(CASE WHEN id = '10' THEN (SELECT max(ord) FROM cases WHERE parent_id = '2') + 1 ELSE ord END AS BIGINT) AS ord FROM cases"""
    ),
    "tree_reorder": _sql(
        """SELECT id, CAST(CASE WHEN parent_id = '' THEN row_number() OVER (PARTITION BY parent_id ORDER BY CASE WHEN id = '5' THEN 1.5 ELSE ord END) - 1
        ELSE ord END AS BIGINT) AS ord FROM cases"""
    ),
    "tree_clone": _sql(
        """, w2 AS (SELECT id FROM cases WHERE id = '9' UNION SELECT c.id FROM w2 w JOIN cases c ON c.parent_id = w.id)
        SELECT 'c' || id AS id, CASE WHEN parent_id IN (SELECT id FROM w2) THEN 'c' || parent_id ELSE parent_id END AS parent_id, '' AS key, '' AS verdict,
        coalesce(CASE WHEN dependencies[1] IN (SELECT id FROM w2) THEN 'c' || dependencies[1] ELSE dependencies[1] END, '') AS deps,
        false AS collapsed, completed, '' AS file_path
        FROM cases WHERE id IN (SELECT id FROM w2)"""
    ),
    "collapsed_overlay": _sql(
        "SELECT id, CASE WHEN ascii(right(project_id, 1)) % 2 = 0 THEN k % 5 = 1 ELSE collapsed END AS collapsed FROM cases"
    ),
    "link_targets": """SELECT p_partkey, 'Notes/' || p_name AS target, CASE WHEN p_partkey % 2 = 0 THEN 'shown' ELSE p_name END AS shown FROM part""",
    "prune_settings": "SELECT n_name AS path, n_nationkey FROM nation WHERE n_nationkey % 4 <> 1",
    "nested_cards": _sql(
        """, u AS (SELECT c.*, lag(c.id) OVER w AS pid, lag(c.parent_id) OVER w AS pp, lag(c.type) OVER w AS pt
          FROM cases c JOIN walk USING (id) WINDOW w AS (PARTITION BY status ORDER BY path))
        SELECT id, coalesce(type = 'subtask' AND parent_id <> '' AND (pid = parent_id OR (pp = parent_id AND pt = 'subtask')), false) AS nested FROM u"""
    ),
    "schedule_patches": _sql(
        f""", g AS (
          SELECT id, CAST(NULL AS DATE) AS latest, start_d AS s, due_d AS d, archived, start_d AS s0, due_d AS d0 FROM cases
          WHERE len(dependencies) = 0 OR dependencies[1] NOT IN (SELECT id FROM cases)
          UNION ALL
          SELECT id, latest, CASE WHEN NOT moves OR ms THEN s0 WHEN s0 IS NULL OR s0 < e THEN e ELSE s0 END,
            CASE WHEN NOT moves THEN d0 WHEN ms THEN CASE WHEN d0 IS NULL OR d0 < e THEN e ELSE d0 END WHEN s0 < e AND d0 IS NOT NULL THEN e + CAST(d0 - s0 AS INT) ELSE d0 END,
            archived, s0, d0
          FROM (SELECT c.id, CASE WHEN NOT g.archived THEN g.d END AS latest, CAST(g.d + 1 AS DATE) AS e, c.start_d AS s0, c.due_d AS d0, c.archived,
              {_OPEN} AND g.d IS NOT NULL AND NOT g.archived AS moves, type = 'milestone' OR (c.start_d IS NULL AND c.due_d IS NOT NULL) AS ms
            FROM g JOIN cases c ON c.dependencies[1] = g.id))
        SELECT id, s AS start_d, d AS due_d FROM g WHERE s IS DISTINCT FROM s0 OR d IS DISTINCT FROM d0"""
    ),
    "schedule_scope": _sql(
        """, g AS (SELECT '13' AS id UNION SELECT c.id FROM g JOIN cases c ON list_contains(c.dependencies, g.id)) SELECT id FROM g"""
    ),
    "would_create_cycle": _sql(
        """, ask(source, target) AS (VALUES ('13', '16'), ('16', '13'), ('13', '21'), ('5', '5')),
        g AS (SELECT source AS a, source AS id FROM ask UNION SELECT g.a, c.id FROM g JOIN cases c ON list_contains(c.dependencies, g.id))
        SELECT source, target, EXISTS (SELECT 1 FROM g WHERE a = source AND id = target) AS cycle FROM ask"""
    ),
    "dependency_arrows": _sql(
        """SELECT p.id AS source, c.id AS target, p.due_d AS source_due, c.start_d AS target_start FROM cases c JOIN cases p ON list_contains(c.dependencies, p.id)
        WHERE c.status <> 'cancelled' AND p.status <> 'cancelled' AND p.due_d IS NOT NULL AND c.start_d IS NOT NULL"""
    ),
}

_FANGS = r"""f AS (
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(regexp_replace(url, '^http', 'hxxp'), '.', '[.]')
    WHEN 1 THEN ' user(at)' || replace(regexp_extract(url, '//([^/?#]+)', 1), '.', '(.)') WHEN 2 THEN md5(url)
    ELSE '10[.]' || (page_id % 250) || '[.]0[.]1 ' END AS value FROM pages),
r AS (
  SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(trim(value), '^hxxp', 'http'), '[.]', '.'), '(.)', '.'), '(at)', '@'), '[@]', '@'), '[:]', ':') AS v FROM f),
t AS (
  SELECT page_id, v, CASE WHEN regexp_matches(v, '^[0-9a-fA-F]{32}$') THEN 'hash' WHEN regexp_matches(v, '^[a-z][a-z0-9+.-]*://') THEN 'url'
    WHEN regexp_matches(v, '^\d{1,3}(\.\d{1,3}){3}$') THEN 'ip' WHEN contains(v, '@') THEN 'email' ELSE 'domain' END AS kind FROM r)
"""

_SHAPES = (
    (0, r"(?i)\bh(?:xx|tt)ps?(?:\[:\]|:)//[^\s<>\"'')]+"),
    (1, r"\b\d{1,3}(?:(?:\[\.\]|\(\.\)|\.)\d{1,3}){3}\b"),
    (2, r"(?i)\b[a-f0-9]{64}\b|\b[a-f0-9]{40}\b|\b[a-f0-9]{32}\b"),
    (3, r"(?i)\b[\w.+-]+(?:@|\[at\]|\(at\))[\w-]+(?:(?:\[\.\]|\(\.\)|\.)[\w-]+)+\b"),
    (4, r"\b[\w-]+(?:(?:\[\.\]|\(\.\))[\w-]+)+\b"),
    (5, r"\b[\w-]+(?:\.[\w-]+)+\b"),
)


def _extract(source: str, key: str, column: str) -> str:
    """Matches with their places, refanged, filtered, first of each value."""
    parts = " UNION ALL ".join(
        f"SELECT id, {n} AS shape, regexp_extract_all(x, '({p})', 1) AS m, string_split_regex(x, '{p}') AS s FROM d" for n, p in _SHAPES
    )
    return rf"""
WITH d AS (SELECT {key} AS id, {column} AS x FROM {source}),
h AS ({parts}),
u AS (SELECT id, shape, m, s, unnest(generate_series(1, len(m))) AS i FROM h WHERE len(m) > 0),
p AS (
  SELECT id, shape, list_sum(list_transform(s[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0) AS place,
    regexp_replace(m[i], '[),.;:!?''"\]]+$', '') AS raw FROM u),
v AS (
  SELECT id, shape, place, replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '^HXXP', 'HTTP'), '^(?i:hxxp)', 'http'),
    '[\[(]\.[\])]', '.', 'g'), '[\[(](?i:at)[\])]', '@', 'g'), '[@]', '@'), '[:]', ':') AS v FROM p),
k AS (
  SELECT * FROM v WHERE CASE shape
    WHEN 1 THEN len(list_filter(string_split(v, '.'), lambda o: CAST(o AS INT) > 255)) = 0
    WHEN 4 THEN contains(v, '.') AND NOT regexp_matches(v, '^\d+(\.\d+)*$')
    WHEN 5 THEN list_contains(string_split('com net org io ru cn info biz co uk de fr xyz top online site club live pw cc su tk ws', ' '),
      lower(string_split(v, '.')[-1])) AND len(string_split(v, '.')) >= 2
    ELSE true END),
f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY id, lower(v) ORDER BY place, shape) = 1)
SELECT id AS {key}, row_number() OVER (PARTITION BY id ORDER BY place, shape) - 1 AS pos,
  CASE WHEN regexp_matches(v, '(?i)^(?:[0-9a-f]{{32}}|[0-9a-f]{{40}}|[0-9a-f]{{64}})$') THEN 'hash' WHEN regexp_matches(v, '(?i)^[a-z][a-z0-9+.-]*://') THEN 'url'
    WHEN regexp_matches(v, '^\d{{1,3}}(\.\d{{1,3}}){{3}}$') THEN 'ip' WHEN contains(v, ':') AND regexp_matches(v, '(?i)^[0-9a-f:]+$') THEN 'ip'
    WHEN contains(v, '@') THEN 'email' ELSE 'domain' END AS type, v AS value FROM f"""


_PATCH = """, patch AS (
  SELECT id, k, CASE WHEN k % 2 = 0 THEN 'done' ELSE 'in-progress' END AS status, CASE WHEN k % 4 = 1 THEN 'sev1' END AS severity,
    CASE WHEN k % 5 = 1 THEN '2001-08-20' END AS due, CASE WHEN k % 7 = 1 THEN 'Ann, Bo' END AS who, k % 6 = 1 AS fewer
  FROM cases WHERE k % 3 = 1)"""

ORACLE_SQL |= {
    "ioc_refang": f"WITH {_FANGS} SELECT page_id, v AS refanged FROM r",
    "ioc_classify": f"WITH {_FANGS} SELECT page_id, kind FROM t",
    "ioc_defang": f"""WITH {_FANGS} SELECT page_id, CASE kind WHEN 'hash' THEN v WHEN 'email' THEN replace(replace(v, '.', '[.]'), '@', '[at]')
      WHEN 'url' THEN replace(replace(regexp_replace(v, '^http', 'hxxp'), '.', '[.]'), '@', '[at]') ELSE replace(v, '.', '[.]') END AS defanged FROM t""",
    "ioc_paste": f"""WITH {_FANGS},
      g AS (SELECT page_id % 50 AS pack, page_id, v, kind FROM t WHERE lower(v) <> '10.3.0.1' QUALIFY row_number() OVER (PARTITION BY page_id % 50, lower(v) ORDER BY page_id) = 1)
      SELECT pack, row_number() OVER (PARTITION BY pack ORDER BY page_id) - 1 AS pos, kind AS type, v AS value FROM g""",
    "ioc_extract_documents": _extract("documents", "doc_id", "text"),
    "ioc_extract_pages": _extract("pages", "page_id", "html"),
    "indicator_search": _sql(
        """SELECT project_id, id, iocs[1] AS value, 'ip: ' || replace(iocs[1], '.', '[.]') AS line FROM cases WHERE contains(iocs[1], '10.77.')"""
    ),
    "reputation_parse": """
WITH e AS (
  SELECT event_id AS n, CASE WHEN event_id % 2 = 0 THEN 'virustotal' ELSE 'abuseipdb' END AS provider,
    CASE WHEN event_id % 17 = 0 THEN 429 WHEN event_id % 19 = 0 THEN 404 WHEN event_id % 23 = 0 THEN 403 WHEN event_id % 29 = 0 THEN 500 ELSE 200 END AS st FROM events),
x AS (
  SELECT *, CASE WHEN st = 429 THEN ['unknown', 'rate limited — retry shortly'] WHEN st = 404 AND provider = 'virustotal' THEN ['unknown', 'not found in VirusTotal']
    WHEN st = 404 THEN ['unknown', 'not found'] WHEN st = 403 THEN ['unknown', 'key rejected'] WHEN st = 500 THEN ['unknown', 'request failed (HTTP 500)']
    WHEN n % 31 = 0 OR n % 37 = 0 THEN ['unknown', 'unreadable response']
    WHEN provider = 'virustotal' THEN CASE WHEN n % 3 + n % 2 + n % 60 + n % 5 = 0 THEN ['unknown', 'no analysis available']
      WHEN n % 3 > 0 THEN ['malicious', (n % 3) || '/' || (n % 3 + n % 2 + n % 60 + n % 5) || ' vendors flag malicious']
      WHEN n % 2 > 0 THEN ['suspicious', (n % 2) || '/' || (n % 3 + n % 2 + n % 60 + n % 5) || ' vendors flag suspicious']
      ELSE ['clean', '0/' || (n % 3 + n % 2 + n % 60 + n % 5) || ' vendors flag it'] END
    ELSE [CASE WHEN n % 101 >= 75 THEN 'malicious' WHEN n % 101 >= 25 THEN 'suspicious' ELSE 'clean' END,
      CASE WHEN n % 101 < 25 AND n % 4 = 0 THEN 'no reports' ELSE (n % 101) || '% confidence · ' || (n % 4) || CASE WHEN n % 4 = 1 THEN ' report' ELSE ' reports' END END] END AS o FROM e)
SELECT n AS event_id, o[1] AS verdict, o[2] AS summary FROM x""",
    "reputation_requests": f"""WITH {_FANGS},
      q AS (SELECT page_id, kind, v, CASE kind WHEN 'email' THEN split_part(v, '@', 2) ELSE v END AS queried,
        CASE kind WHEN 'ip' THEN 'ip_addresses' WHEN 'hash' THEN 'files' WHEN 'url' THEN 'urls' ELSE 'domains' END AS p FROM t)
      SELECT page_id, 'virustotal' AS provider, queried, 'https://www.virustotal.com/api/v3/' || p || '/' ||
        CASE kind WHEN 'url' THEN rtrim(replace(replace(base64(encode(v)), '+', '-'), '/', '_'), '=') ELSE queried END AS request FROM q
      UNION ALL SELECT page_id, 'abuseipdb', v, 'https://api.abuseipdb.com/api/v2/check?ipAddress=' || v || '&maxAgeInDays=90' FROM q WHERE kind = 'ip'""",
    "completion_outcome": _sql(
        """SELECT id, CASE WHEN completed_d > due_d THEN CAST(completed_d - due_d AS INT) || 'd late' WHEN completed_d <= due_d THEN 'On time' END AS outcome FROM cases"""
    ),
    "relative_due": _sql(
        """, d AS (SELECT id, date_diff('day', DATE '2001-08-02', due_d) AS n FROM cases)
        SELECT id, CASE WHEN n < 0 THEN (-n) || 'd overdue' WHEN n = 0 THEN 'Today' WHEN n = 1 THEN 'Tomorrow' WHEN n <= 6 THEN 'In ' || n || 'd' END AS due_text FROM d"""
    ),
    "due_urgency": _sql(
        f"""SELECT id, CASE WHEN NOT ({_OPEN}) OR due_d IS NULL THEN 'normal' WHEN due_d < {_DUE} THEN 'overdue' WHEN due_d < {_DUE} + 3 THEN 'near' ELSE 'normal' END AS urgency FROM cases"""
    ),
    "iso_week": "SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS week FROM orders",
    "timeline_bars": _sql(
        """, b AS (SELECT id, progress, date_diff('day', DATE '2001-07-01', start_d) * 12.0::DOUBLE AS x, greatest((date_diff('day', start_d, due_d) + 1) * 12.0::DOUBLE, 8) AS width FROM cases WHERE due_d IS NOT NULL)
        SELECT id, x, width, round(width * progress / 100, 6) AS done_width FROM b"""
    ),
    "milestones": _sql("SELECT id, coalesce(due_d, start_d) AS day FROM cases WHERE type = 'milestone'"),
    "activity_diff": _sql(
        _PATCH
        + """, x AS (
          SELECT c.id, 1 AS o, 'status' AS field, c.status AS was, p.status AS now_is FROM cases c JOIN patch p USING (id) WHERE c.status <> p.status
          UNION ALL SELECT c.id, 2, 'severity', c.severity, p.severity FROM cases c JOIN patch p USING (id) WHERE c.severity <> p.severity
          UNION ALL SELECT c.id, 5, 'assignees', array_to_string(c.assignees, ', '), who FROM cases c JOIN patch p USING (id) WHERE array_to_string(c.assignees, ', ') <> who
          UNION ALL SELECT c.id, 6, 'due', c.due, p.due FROM cases c JOIN patch p USING (id) WHERE c.due <> p.due
          UNION ALL SELECT c.id, 8, 'iocs', c.iocs[1], '' FROM cases c JOIN patch p USING (id) WHERE fewer)
        SELECT id, row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS pos, field, was, now_is FROM x"""
    ),
    "completion_stamp": _sql(
        _PATCH
        + """SELECT c.id, CASE WHEN p.status = 'done' THEN '2001-08-02' ELSE '' END AS completed FROM cases c JOIN patch p USING (id)
        WHERE (p.status = 'done') <> (c.status IN ('done', 'cancelled'))"""
    ),
    "lifecycle_stamp": _sql(
        _PATCH
        + """, x AS (
          SELECT c.id, CASE WHEN responded_at = '' THEN '2001-08-02T12:00:00Z' END AS responded_at,
            CASE WHEN resolved_at = '' AND p.status = 'done' THEN '2001-08-02T12:00:00Z' END AS resolved_at
          FROM cases c JOIN patch p USING (id) WHERE issue_type = 'incident' AND c.status <> p.status)
        SELECT * FROM x WHERE responded_at IS NOT NULL OR resolved_at IS NOT NULL"""
    ),
    "ioc_diff": _sql(
        """SELECT id, iocs[2] AS was, '' AS now_is FROM cases WHERE k % 2 = 0 UNION ALL SELECT id, '', '10.9.9.9' FROM cases WHERE k % 2 = 1
        UNION ALL SELECT id, unnest(iocs), '' FROM cases WHERE k % 2 = 1"""
    ),
    "apply_patches": _sql(
        _PATCH
        + """SELECT c.id, coalesce(p.status, c.status) AS status, coalesce(p.severity, c.severity) AS severity, coalesce(p.due, c.due) AS due,
          CASE WHEN p.id IS NULL THEN completed WHEN p.status = 'done' AND c.status NOT IN ('done', 'cancelled') THEN '2001-08-02'
            WHEN p.status <> 'done' AND c.status IN ('done', 'cancelled') THEN '' ELSE completed END AS completed,
          CASE WHEN p.id IS NOT NULL AND issue_type = 'incident' AND p.status <> c.status AND responded_at = '' THEN '2001-08-02T12:00:00Z' ELSE responded_at END AS responded_at,
          CASE WHEN p.id IS NOT NULL AND issue_type = 'incident' AND p.status <> c.status AND resolved_at = '' AND p.status = 'done' THEN '2001-08-02T12:00:00Z' ELSE resolved_at END AS resolved_at,
          coalesce(replace(who, ', ', ','), array_to_string(assignees, ',')) AS who
        FROM cases c LEFT JOIN patch p USING (id)"""
    ),
    "tree_diff": _sql(
        """, x AS (SELECT id, k, status, CASE WHEN k % 3 = 0 THEN 'todo' ELSE status END AS s2 FROM cases)
        SELECT id, CASE WHEN k % 5 = 0 THEN 'new' WHEN k % 7 = 0 THEN 'removed' ELSE 'changed' END AS change FROM x
        WHERE NOT (k % 5 = 0 AND k % 7 = 0) AND (k % 5 = 0 OR k % 7 = 0 OR status <> s2)"""
    ),
    "assign_keys": _sql(
        """SELECT id, 'INC-' || (row_number() OVER (PARTITION BY project_id ORDER BY created_at, tree_pos, id) + 99) AS key FROM cases WHERE k % 4 = 0"""
    ),
    "adopt_keys": _sql(
        r""", x AS (
          SELECT project_id, id, CASE WHEN k % 5 = 0 THEN 'OPS-' || id ELSE '' END AS key, title, created_at, tree_pos,
            TRY_CAST(nullif(regexp_extract(title, '^OPS-(\d+):', 1), '') AS BIGINT) AS seq, k FROM cases),
        has AS (SELECT DISTINCT project_id FROM x WHERE seq IS NOT NULL),
        used AS (SELECT DISTINCT project_id, CAST(id AS BIGINT) AS seq FROM x WHERE key <> ''),
        ad AS (
          SELECT project_id, id, seq, regexp_replace(title, '^OPS-\d+:\s*', '') AS title FROM x
          WHERE key = '' AND seq IS NOT NULL AND NOT EXISTS (SELECT 1 FROM used u WHERE u.project_id = x.project_id AND u.seq = x.seq)
          QUALIFY row_number() OVER (PARTITION BY project_id, seq ORDER BY tree_pos) = 1),
        tops AS (SELECT project_id, max(seq) AS top FROM (SELECT project_id, seq FROM used UNION ALL SELECT project_id, seq FROM ad) GROUP BY 1)
        SELECT id, 'OPS-' || seq AS key, title, 'adopted' AS how FROM ad
        UNION ALL
        SELECT x.id, 'OPS-' || (coalesce(top, 0) + row_number() OVER (PARTITION BY x.project_id ORDER BY created_at, tree_pos, x.id)), x.title, 'assigned'
        FROM x JOIN has USING (project_id) LEFT JOIN tops USING (project_id) WHERE key = '' AND x.id NOT IN (SELECT id FROM ad)"""
    ),
    "embedded_key": _sql(
        r"""SELECT id, 'OPS' AS prefix, CAST(regexp_extract(title, '^OPS-(\d+):', 1) AS BIGINT) AS seq, regexp_replace(title, '^OPS-\d+:\s*', '') AS rest
        FROM cases WHERE k % 9 = 0"""
    ),
    "catalog_remap": _sql("SELECT id, CASE WHEN status = 'review' AND project_id NOT IN ('P3', 'P4') THEN 'todo' ELSE status END AS status FROM cases"),
    "type_coercion": _sql(
        """SELECT id, CASE WHEN type = 'subtask' AND parent_id = '' THEN 'task' ELSE type END AS type, CASE WHEN type = 'milestone' THEN '' ELSE start END AS start,
        CASE WHEN type = 'milestone' THEN 0.0 ELSE progress END AS progress, CASE WHEN type = 'milestone' THEN '' ELSE parent_id END AS parent_id FROM cases"""
    ),
    "bulk_update": _sql(
        """SELECT id, CASE WHEN k % 6 = 2 THEN 'today' ELSE bucket END AS bucket,
        array_to_string(CASE WHEN k % 6 = 2 THEN list_append(tags, 'bulk') ELSE tags END, ',') AS tags FROM cases"""
    ),
    "archive_move": _sql(
        """SELECT c.id, 'Cases/' || c.project_id || '_tasks/' || CASE WHEN c.k % 9 = 4 OR (c.k % 9 = 5 AND p.id IS NOT NULL) THEN 'Archive/' ELSE '' END
          || CASE WHEN c.k % 9 = 5 THEN (c.k - 1) || '/sub/' ELSE '' END || c.id || '.md' AS file_path, c.archived OR c.k % 9 = 4 AS archived
        FROM cases c LEFT JOIN cases p ON p.id = CAST(c.k - 1 AS VARCHAR) AND p.project_id = c.project_id"""
    ),
    "dirty_merge": "SELECT CAST(user_id AS VARCHAR) AS id, CASE WHEN bool_or(event_type = 'signup') THEN 'full' ELSE 'fm' END AS kind FROM events GROUP BY 1",
    "recents": _sql(
        """, l AS (SELECT CAST(user_id AS VARCHAR) AS id, epoch_us(max(ts)) // 1000 AS last_ms FROM events GROUP BY 1),
        t AS (SELECT * FROM l WHERE id IN (SELECT id FROM cases) ORDER BY last_ms DESC, id LIMIT 15)
        SELECT id, last_ms, row_number() OVER (ORDER BY last_ms DESC, id) AS pos FROM t"""
    ),
    "free_name": "SELECT 'Plan (copy ' || min(n) || ')' AS name FROM range(2, 1000) t(n) WHERE n NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey <> 1)",
    "catalog_resolve": _sql(
        """, used AS (SELECT project_id, CASE WHEN k % 77 = 5 THEN 'odd' ELSE status END AS id, min(tree_pos) AS f FROM cases GROUP BY 1, 2),
        own(project_id, pos, id, label, complete) AS (VALUES ('P1', 0, 'open', 'Open', false), ('P1', 1, 'todo', 'Queue', false), ('P1', 2, 'done', 'Shut', true)),
        base AS (SELECT * FROM own UNION ALL SELECT DISTINCT u.project_id, s.pos, sid, slabel, term FROM used u, statuses s WHERE u.project_id <> 'P1'),
        ex AS (SELECT u.project_id, u.f, u.id, coalesce(slabel, u.id) AS label, coalesce(term, false) AS complete FROM used u LEFT JOIN statuses ON sid = u.id
          WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.project_id = u.project_id AND b.id = u.id)),
        al AS (SELECT project_id, 0 AS part, pos AS f, id, label, complete FROM base UNION ALL SELECT project_id, 1, f, id, label, complete FROM ex)
        SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY part, f, id) AS pos, id, label, complete FROM al"""
    ),
    "import_map": """SELECT 'Notes/' || p_name || '.md' AS path, p_name AS title, CASE WHEN p_partkey % 4 = 0 THEN 'done' ELSE 'todo' END AS status, 'medium' AS priority,
      '2001-08-01' AS start, CASE WHEN p_partkey % 2 = 0 THEN '2001-08-09' ELSE '' END AS due, 't' || (p_partkey % 5) AS tags,
      CASE p_partkey % 5 WHEN 0 THEN 'weekly' WHEN 1 THEN 'daily' END AS interval, CAST(CASE p_partkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 END AS INT) AS every,
      CASE WHEN p_partkey % 400 > 0 THEN round(CAST(p_partkey % 400 AS DOUBLE) / 60, 2) END AS time_estimate, p_partkey % 6 = 0 AS archived,
      CASE WHEN p_partkey % 7 = 0 THEN '2001-07-01T08:00:00Z' ELSE '2001-08-02T12:00:00Z' END AS created_at,
      CASE WHEN p_partkey % 7 = 1 THEN '2001-07-02T08:00:00Z' ELSE '2001-08-02T12:00:00Z' END AS updated_at FROM part""",
    "notifier_due": _sql(
        f"SELECT id, due_d, CASE WHEN due_d < {_DUE} THEN 'overdue' ELSE 'soon' END AS kind FROM cases WHERE {_OPEN} AND due_d <= {_DUE} + 2"
    ),
    "notifier_sla_breach": _sql(
        f"SELECT c.id, phase FROM cases c JOIN sla s USING (id) WHERE NOT archived AND {_OPEN} AND breached AND NOT done AND NOT (k % 6 = 0 AND phase = 'response')"
    ),
    "verdict_guard": _where("issue_type = 'incident' AND verdict = '' AND k % 2 = 0"),
    "label_lookup": _sql(
        """SELECT id, slabel AS status_label, CAST(pos AS BIGINT) AS status_rank, upper(priority[1]) || priority[2:] AS priority_label, term AS terminal FROM cases JOIN statuses ON sid = status"""
    ),
    "comment_preview": r"""
WITH x AS (SELECT conv_id, turn, '## ' || role || chr(10) || '**' || text || '** `x` ![a](b) snake_case' || chr(10) || '1. one' AS t FROM conversations),
y AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(t, '(?s)```.*?```', ' ', 'g'), '`([^`]*)`', '\1', 'g'), '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g') AS t FROM x)
SELECT conv_id, turn, substr(trim(regexp_replace(regexp_replace(regexp_replace(t, '(?m)^[ \t]*[#>\-*+]+[ \t]+', '', 'g'), '[*~]', '', 'g'), '\s+', ' ', 'g')), 1, 240) AS preview FROM y""",
    "name_functions": r"""
WITH x AS (SELECT *, p_name || ': "' || p_type || '"/' || p_brand AS t FROM part),
y AS (SELECT *, regexp_replace(substr(trim(regexp_replace(t, '[\\/:*?"<>|#^\[\]]', '-', 'g')), 1, 60), '[. ]+$', '') AS fn, string_split_regex(trim(p_name), '\s+') AS w FROM x)
SELECT p_partkey, regexp_replace(lower(trim(t)), '\s+', '-', 'g') AS slug,
  upper(CASE WHEN len(w) > 1 THEN w[1][1] || w[2][1] ELSE substr(p_name, 1, 2) END) AS initials,
  upper(CASE WHEN len(string_split_regex(trim(p_brand), '\s+')) > 1 THEN NULL ELSE substr(p_brand, 1, 2) END) AS brand_initials,
  CASE WHEN length(t) > 20 THEN substr(t, 1, 19) || '…' ELSE t END AS short, fn AS file_name FROM y""",
    "project_path_layout": "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_name || '/Tasks' WHEN 1 THEN 'root/Tasks/' || n_name ELSE 'Cases/' || n_name || '_tasks' END AS folder FROM nation",
    "flagship": _sql(
        """SELECT CASE WHEN severity = '' THEN 'none' ELSE severity END AS severity, CAST(0 AS BIGINT) AS met, count(*) FILTER (done) AS breached, CAST(0 AS BIGINT) AS no_data,
        count(*) FILTER (NOT done) AS "open" FROM cases JOIN sla USING (id) WHERE NOT archived AND severity IN ('sev1', 'sev2') AND breached GROUP BY 1"""
    ),
    "yaml_round_trip": _sql(
        r"""SELECT id, row_number() OVER (PARTITION BY project_id, parent_id ORDER BY CASE WHEN parent_id = '' THEN 0 ELSE ord END, created_at, id) - 1 AS ord,
        key, title, type, status, severity, verdict, due, progress, parent_id, archived, CASE WHEN time_estimate > 0 THEN time_estimate END AS time_estimate,
        array_to_string(tags, ',') AS tags, array_to_string(dependencies, ',') AS deps, iocs[2] AS second_ioc, 'seen' || chr(10) || 'by ' || id AS comment,
        'Line "one"' || chr(10) || 'and \\ two of ' || title AS description, project_id AS site FROM cases"""
    ),
}

_OWN = """, own(project_id, pos, id, complete) AS (VALUES ('P1', 0, 'open', false), ('P1', 1, 'todo', false), ('P1', 2, 'done', true), ('P2', 0, 'review', true), ('P2', 1, 'done', false)),
  u AS (SELECT project_id, status AS id, min(tree_pos) AS f FROM cases GROUP BY 1, 2),
  base AS (SELECT * FROM own UNION ALL SELECT DISTINCT u.project_id, s.pos, sid, term FROM u, statuses s WHERE u.project_id NOT IN ('P1', 'P2')),
  al AS (SELECT project_id, 0 AS part, pos AS f, id, complete FROM base UNION ALL
    SELECT u.project_id, 1, u.f, u.id, coalesce(term, false) FROM u LEFT JOIN statuses ON sid = u.id WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.project_id = u.project_id AND b.id = u.id)),
  cat AS (SELECT project_id, id AS sid, complete, row_number() OVER (PARTITION BY project_id ORDER BY part, f, id) - 1 AS place FROM al)
"""
_LINES = """WITH t AS (SELECT c_custkey AS n, DATE '2000-11-03' + CAST(c_custkey % 400 AS INT) AS o FROM customer), tl AS (SELECT n, o, o + CAST(n % 120 + 1 AS INT) AS e FROM t)"""
_NEW = "p.status IS NOT NULL AND p.status <> c.status"

ORACLE_SQL |= {
    "own_catalog_progress": _sql(
        _OWN + "SELECT c.project_id, count(*) AS total, count(*) FILTER (x.complete) AS done FROM cases c JOIN cat x ON x.project_id = c.project_id AND x.sid = c.status GROUP BY 1"
    ),
    "own_catalog_ranks": _sql(
        _OWN
        + f"""SELECT c.id, x.place AS status_rank, x.complete AS terminal, CASE WHEN x.complete OR due_d IS NULL THEN 'normal' WHEN due_d < {_DUE} THEN 'overdue' WHEN due_d < {_DUE} + 3 THEN 'near' ELSE 'normal' END AS urgency
        FROM cases c JOIN cat x ON x.project_id = c.project_id AND x.sid = c.status"""
    ),
    "own_catalog_stamps": _sql(
        _OWN
        + f""", p AS (SELECT id, CASE WHEN k % 4 = 0 THEN 'done' ELSE 'review' END AS status FROM cases WHERE k % 2 = 0),
        y AS (SELECT c.*, p.status AS ps, coalesce(a.complete, false) AS was, coalesce(b.complete, false) AS now_over, {_NEW} AS moved FROM cases c LEFT JOIN p USING (id)
          LEFT JOIN cat a ON a.project_id = c.project_id AND a.sid = c.status LEFT JOIN cat b ON b.project_id = c.project_id AND b.sid = p.status)
        SELECT id, coalesce(ps, status) AS status, CASE WHEN ps IS NULL THEN completed WHEN now_over AND NOT was THEN '2001-08-02' WHEN was AND NOT now_over THEN '' ELSE completed END AS completed,
          CASE WHEN moved AND issue_type = 'incident' AND now_over AND resolved_at = '' THEN '2001-08-02T12:00:00Z' ELSE resolved_at END AS resolved_at FROM y"""
    ),
    "remap_logged": _sql(
        """, y AS (SELECT *, status = 'cancelled' AND project_id NOT IN ('P3', 'P4') AS hit FROM cases)
        SELECT id, CASE WHEN hit THEN 'todo' ELSE status END AS status, CASE WHEN hit THEN '' ELSE completed END AS completed,
          CASE WHEN hit AND issue_type = 'incident' AND responded_at = '' THEN '2001-08-02T12:00:00Z' ELSE responded_at END AS responded_at,
          CAST(hit AS BIGINT) AS entries, CASE WHEN hit THEN 'cancelled' END AS was FROM y"""
    ),
    "adopt_stored_prefix": _sql(
        r""", x AS (SELECT project_id, id, tree_pos, TRY_CAST(nullif(regexp_extract(title, '^OPS-(\d+):', 1), '') AS BIGINT) AS seq FROM cases),
        has AS (SELECT DISTINCT project_id FROM x WHERE seq IS NOT NULL UNION SELECT 'P1'),
        y AS (SELECT *, seq IS NOT NULL AND row_number() OVER (PARTITION BY project_id, seq ORDER BY tree_pos) = 1 AS first FROM x JOIN has USING (project_id))
        SELECT id, CASE WHEN project_id = 'P1' THEN 'SEC' ELSE 'OPS' END AS prefix, CASE WHEN first THEN 'adopted' ELSE 'assigned' END AS how FROM y"""
    ),
    "incident_templates": _sql(
        """SELECT id, 'incident' AS issue_type, 'sev2' AS severity, 'high' AS priority, 'malware' AS tags, CAST(7 AS BIGINT) AS parts, '2001-08-02T12:00:00Z' AS detected_at FROM cases WHERE issue_type = 'task'"""
    ),
    "name_hue": """SELECT c_custkey, abs(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, length(c_name) + 1), i -> CAST(ascii(substr(c_name, i, 1)) AS BIGINT))),
      lambda h, c: c + ((((((h + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) * 32 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) - h)) % 360 AS hue FROM customer""".replace("i -> CAST", "lambda i: CAST"),
    "import_note": """SELECT 'Notes/a/' || c_name || '.md' AS path, c_name AS title, 'Body of ' || c_name AS description, c_custkey % 3 = 0 AS skipped FROM customer""",
    "palette_upsert": _sql(
        """, r(a, b, id, label) AS (VALUES (-1, 1, 'first', 'First'), (0, 0, 'todo', 'To Do'), (1, 0, 'in-progress', 'In Progress'), (2, 0, 'blocked', 'Stuck'), (2, 3, 'wait', 'Waiting'),
          (3, 0, 'review', 'In Review'), (4, 0, 'done', 'Done'), (5, 0, 'cancelled', 'Cancelled')),
        al AS (SELECT * FROM r UNION ALL SELECT DISTINCT 1000, 0, 'odd', 'odd' FROM cases WHERE k % 5 = 0)
        SELECT row_number() OVER (ORDER BY a, b, id) - 1 AS ord, id, label FROM al"""
    ),
    "timeline_weeks": _LINES
    + """, d AS (SELECT n, o, e, CAST(o + CAST(i AS INT) AS DATE) AS d FROM tl, range(0, 121) r(i) WHERE o + CAST(i AS INT) < e),
      w AS (SELECT n, o, d, CASE WHEN d = o AND isodow(d) > 1 THEN 8 - isodow(d) ELSE least(7, e - d) END AS days FROM d WHERE d = o OR isodow(d) = 1),
      x AS (SELECT *, CAST(d + CAST(days - 1 AS INT) AS DATE) AS l FROM w)
      SELECT CAST(n AS INT) AS n, 'W' || weekofyear(d) || ': ' || strftime(d, '%b') || ' ' || day(d) || CASE WHEN month(d) = month(l) THEN '–' || day(l) ELSE ' – ' || strftime(l, '%b') || ' ' || day(l) END AS label,
        (d - o) * 24.0::DOUBLE AS x, days * 24.0::DOUBLE AS width FROM x""",
    "timeline_bands": _LINES
    + """, m AS (SELECT n, o, e, CAST(date_trunc('year', o) AS DATE) AS y FROM tl),
      b AS (SELECT n, o, e, 'month_year' AS unit, 1 AS len, CAST(y + to_months(CAST(i AS INT)) AS DATE) AS d FROM m, range(0, 24) r(i)
        UNION ALL SELECT n, o, e, 'quarter', 3, CAST(y + to_months(CAST(3 * i AS INT)) AS DATE) FROM m, range(0, 8) r(i)
        UNION ALL SELECT n, o, e, 'year', 12, CAST(y + to_months(CAST(12 * i AS INT)) AS DATE) FROM m, range(0, 2) r(i)),
      c AS (SELECT *, greatest(d, o) AS f, least(CAST(d + to_months(len) AS DATE), e) AS l FROM b)
      SELECT CAST(n AS INT) AS n, unit, CASE unit WHEN 'year' THEN CAST(year(d) AS VARCHAR) WHEN 'quarter' THEN 'Q' || quarter(d) || ' ' || year(d) ELSE strftime(d, '%b %y') END AS label,
        (f - o) * 8.0::DOUBLE AS x, (l - f) * 8.0::DOUBLE AS width FROM c WHERE f < l""",
    "timeline_snap": _LINES
    + """, d AS (SELECT n, CAST(i AS INT) AS i, CAST(o + CAST(i AS INT) AS DATE) AS d FROM tl, range(0, 122) r(i) WHERE o + CAST(i AS INT) <= e),
      g AS (SELECT n, count(*) AS day_points, count(*) FILTER (isodow(d) IN (1, 4)) AS week_points, count(*) FILTER (day(d) IN (1, 8, 15, 22)) AS month_points, count(*) FILTER (day(d) = 1) AS quarter_points FROM d GROUP BY n),
      s AS (SELECT n, i * 10.0::DOUBLE AS p FROM d WHERE day(d) IN (1, 8, 15, 22) AND abs(n % 900 - i * 10) <= 25 QUALIFY row_number() OVER (PARTITION BY n ORDER BY abs(n % 900 - i * 10), i) = 1)
      SELECT CAST(n AS INT) AS n, day_points, week_points, month_points, quarter_points, coalesce(p, CAST(n % 900 AS DOUBLE)) AS snapped FROM g LEFT JOIN s USING (n)""",
    "local_input": _sql(
        """SELECT id, strftime(epoch_ms(created_ms + 19800000), '%Y-%m-%dT%H:%M') AS there, strftime(epoch_ms(created_ms // 60000 * 60000), '%Y-%m-%dT%H:%M:00.000Z') AS back FROM cases"""
    ),
    "project_round_trip": _sql(
        """, r AS (SELECT project_id, string_agg(id, ',' ORDER BY k) AS roots FROM cases WHERE k % 40 < 10 OR parent_id = '' GROUP BY 1)
        SELECT 'P' || n_nationkey AS id, n_name AS title, 'Two "lines"' || chr(10) || 'of ' || n_name AS description, '#abcdef' AS color, CASE WHEN n_nationkey % 2 = 0 THEN 'SOC' ELSE '' END AS key_prefix,
          CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 5 ELSE 1 END AS BIGINT) AS next_key_seq, 'Ann,' || n_name AS team, coalesce(roots, '') AS roots,
          CASE WHEN n_nationkey = 3 THEN 'Mine' END AS view_name, CASE WHEN n_nationkey = 3 THEN 'a,b' END AS view_tags, CASE WHEN n_nationkey = 3 THEN 'desc' END AS view_dir,
          CASE WHEN n_nationkey % 4 <> 1 THEN 'Open "' || n_name || '"' END AS status_label, CASE WHEN n_nationkey % 4 <> 1 AND n_nationkey > 0 THEN CAST(n_nationkey AS DOUBLE) END AS wip_limit,
          CASE WHEN n_nationkey % 4 <> 1 THEN n_nationkey % 3 = 0 END AS auto_schedule, 'Cases/' || n_name || '.md' AS file_path
        FROM nation LEFT JOIN r ON project_id = 'P' || n_nationkey"""
    ),
    "embedded_tasks": """SELECT 'R' || n_regionkey AS project_id, 'n' || n_nationkey AS id, n_name AS title, 'blocked' AS status, '' AS parent_id,
        row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS ord, false AS collapsed FROM nation
      UNION ALL SELECT 'R' || n_regionkey, 's' || n_nationkey, 'Sub', 'todo', 'n' || n_nationkey, 0, true FROM nation""",
    "saved_view": _sql("SELECT id, 'v2' AS view_name FROM cases WHERE severity IN ('sev1', 'sev2') AND status IN ('todo', 'blocked') AND NOT archived"),
}

_PARTS = {1: ("## Open incidents", "None."), 2: ("## Changed in the last 60h", "Nothing recorded."), 3: ("## Response/resolution targets at risk", "None."), 4: ("## Blocked", "None.")}
_OPEN_INCIDENT = f"NOT archived AND issue_type = 'incident' AND {_OPEN}"
_FIXED = ["(0, '# Shift handover')", "(0, '')", "(0, 'Generated 2001-08-02T12:00:00Z · window 60h · this note is overwritten on every run.')", "(0, '')"]
_FIXED += [f"({p}, '{x}')" for p, (name, _) in _PARTS.items() for x in (name, "", "")]
_FOUND = f"""
  SELECT 1 AS part, line FROM ({ORACLE_SQL["handover_open_incidents"]})
  UNION ALL SELECT DISTINCT 1, '### ' || severity_label FROM ({ORACLE_SQL["handover_open_incidents"]})
  UNION ALL SELECT 1, unnest(['  - ip: ' || replace(iocs[1], '.', '[.]'), '  - domain: ' || replace(iocs[2], '.', '[.]') || ' — seen']) FROM cases WHERE {_OPEN_INCIDENT}
  UNION ALL SELECT 2, line FROM ({ORACLE_SQL["changed_in_window"]})
  UNION ALL SELECT 2, '- ' || {_LABEL} || ':' FROM cases WHERE id IN (SELECT id FROM ({ORACLE_SQL["changed_in_window"]}))
  UNION ALL SELECT 3, '- ' || {_LABEL} || ' — ' || risk FROM ({ORACLE_SQL["targets_at_risk"]}) JOIN cases USING (id)
  UNION ALL SELECT 4, '- ' || label || CASE WHEN assignees <> '' THEN ' · ' || assignees ELSE '' END FROM ({ORACLE_SQL["blocked"]})"""
ORACLE_SQL["handover_note"] = _sql(
    f""", found AS ({_FOUND}), fixed(part, line) AS (VALUES {', '.join(_FIXED)}),
    empty(part, line) AS (VALUES {', '.join(f"({p}, '{x}')" for p, (_, x) in _PARTS.items())})
    SELECT * FROM found UNION ALL SELECT * FROM fixed UNION ALL SELECT * FROM empty WHERE part NOT IN (SELECT part FROM found)"""
)
