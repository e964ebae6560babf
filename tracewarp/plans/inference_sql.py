"""DuckDB SQL of the graph and inference operators, as common table expressions over the views: the oracles of the catalogue."""

from __future__ import annotations

from tracewarp.operators.inference import WEIGHTS

#: (source, target, calls, errors, duration_ns)
EDGES = """calls AS (
  SELECT service AS source, peer_service AS target, status, duration_ns FROM spans WHERE peer_service <> service
  UNION ALL
  SELECT p.service, s.service, s.status, s.duration_ns FROM spans s JOIN spans p ON s.parent_span_id = p.span_id
  WHERE (s.peer_service IS NULL OR s.peer_service = s.service) AND p.service <> s.service AND (p.start_time_ns, p.span_id) < (s.start_time_ns, s.span_id)),
edges AS (SELECT source, target, count(*) AS calls, CAST(sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(duration_ns) AS BIGINT) AS duration_ns FROM calls GROUP BY source, target)"""

#: (service, caller)
REACH = """pairs_once AS MATERIALIZED (SELECT DISTINCT source, target FROM edges),
reach AS (SELECT target AS service, source AS caller FROM pairs_once UNION SELECT r.service, e.source FROM reach r JOIN pairs_once e ON e.target = r.caller)"""

#: Spans with the parent that they have in their trace, roots, and the time that the walk back from the end gives each span: (lim - a) less what its children get.
CRITICAL = """par AS MATERIALIZED (SELECT s.*, p.span_id AS pid, p.service AS parent_service FROM spans s LEFT JOIN spans p ON s.trace_id = p.trace_id AND s.parent_span_id = p.span_id),
root AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY end_time_ns - start_time_ns DESC, start_time_ns, span_id) AS rn FROM par WHERE pid IS NULL) WHERE rn = 1),
walk AS (
  SELECT trace_id, span_id, service, CAST(NULL AS VARCHAR) AS parent_service, start_time_ns AS a, end_time_ns AS lim FROM root WHERE end_time_ns > start_time_ns
  UNION ALL
  SELECT trace_id, span_id, service, parent_service, a, least(b, cursor) FROM (
    SELECT k.trace_id, k.span_id, k.service, k.parent_service, k.start_time_ns AS a, k.end_time_ns AS b,
      least(w.lim, coalesce(min(k.start_time_ns) OVER (PARTITION BY w.trace_id, w.span_id ORDER BY k.end_time_ns DESC, k.span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w.lim)) AS cursor
    FROM walk w JOIN par k ON k.trace_id = w.trace_id AND k.pid = w.span_id AND k.start_time_ns >= w.a AND k.start_time_ns < w.lim)
  WHERE a < cursor AND least(b, cursor) > a),
shares AS (SELECT trace_id, service, lim - a AS ns FROM walk UNION ALL SELECT trace_id, parent_service, a - lim FROM walk WHERE parent_service IS NOT NULL),
bad AS (SELECT trace_id FROM spans GROUP BY trace_id HAVING bool_or(status = 'error')),
critical AS (SELECT trace_id, service, CAST(sum(ns) AS BIGINT) AS contribution_ns FROM shares GROUP BY ALL HAVING sum(ns) > 0)"""

#: (failed_trace_id, operation, cohort, median_trace_id, confidence)
COHORT = """t AS (SELECT trace_id, list_sort(list(DISTINCT service)) AS services, coalesce(bool_or(status = 'error'), false) AS failed FROM spans GROUP BY trace_id),
rt AS (SELECT trace_id, operation, start_time_ns, end_time_ns - start_time_ns AS envelope, row_number() OVER (PARTITION BY trace_id ORDER BY end_time_ns - start_time_ns DESC, span_id) AS rn
  FROM (SELECT s.*, p.span_id AS pid FROM spans s LEFT JOIN spans p ON s.parent_span_id = p.span_id) WHERE pid IS NULL),
r AS (SELECT t.*, rt.operation, rt.start_time_ns, rt.envelope FROM t JOIN rt ON t.trace_id = rt.trace_id AND rn = 1),
kinds AS (SELECT DISTINCT operation, services FROM r WHERE failed),
c AS (SELECT f.operation, f.services, h.trace_id, h.envelope, h.start_time_ns,
    len(list_intersect(f.services, h.services)) / len(list_distinct(list_concat(f.services, h.services))) AS sim
  FROM kinds f JOIN r h ON NOT h.failed AND f.operation = h.operation),
k AS (SELECT *, row_number() OVER (PARTITION BY operation, services ORDER BY start_time_ns DESC, trace_id) AS rn FROM c WHERE sim >= 0.5),
g AS (SELECT operation, services, list(trace_id ORDER BY rn) AS cohort, list(trace_id ORDER BY envelope, trace_id) AS by_length, avg(sim) * least(count(*) / 3.0, 1.0) AS confidence FROM k WHERE rn <= 20 GROUP BY operation, services),
cohorts AS (SELECT r.trace_id AS failed_trace_id, r.operation, array_to_string(coalesce(cohort, []), ' ') AS cohort, by_length[len(by_length) // 2 + 1] AS median_trace_id, round(coalesce(confidence, 0.0), 6) AS confidence
  FROM r LEFT JOIN g ON r.operation = g.operation AND r.services = g.services WHERE failed)"""

#: Spans by causal path and number.
PATHS = """up AS (
  SELECT trace_id, span_id, service || ':' || operation AS path, start_time_ns, end_time_ns - start_time_ns AS ns, service FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spans p WHERE p.trace_id = s.trace_id AND p.span_id = s.parent_span_id)
  UNION ALL
  SELECT s.trace_id, s.span_id, u.path || ' > ' || s.service || ':' || s.operation, s.start_time_ns, s.end_time_ns - s.start_time_ns, s.service FROM up u JOIN spans s ON s.trace_id = u.trace_id AND s.parent_span_id = u.span_id),
paths AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY trace_id, path ORDER BY start_time_ns, span_id) - 1 AS ordinal FROM up),
medians AS (SELECT failed_trace_id, median_trace_id AS healthy_trace_id FROM cohorts WHERE median_trace_id IS NOT NULL)"""

#: Robust z of each sample.
Z = """s AS (SELECT *, list(value) OVER (PARTITION BY service, name ORDER BY event_time, event_id ROWS BETWEEN 32 PRECEDING AND 1 PRECEDING) AS b FROM metrics),
m AS (SELECT *, CASE WHEN len(b) >= 5 THEN list_median(b) END AS med FROM s),
d AS (SELECT *, list_transform(b, lambda x: abs(x - med)) AS dev FROM m),
z AS (SELECT event_id, service, name, event_time, value, coalesce(len(b), 0) AS baseline_n, CASE WHEN len(b) >= 5 THEN greatest(least(
    CASE WHEN list_median(dev) > 0 THEN 0.6745 * (value - med) / list_median(dev) WHEN list_avg(dev) > 0 THEN 0.7979 * (value - med) / list_avg(dev)
         WHEN abs(value - med) <= 1e-9 THEN 0.0 ELSE sign(value - med) * 8.0 END, 8.0), -8.0) END AS z FROM d)"""

#: (service, name, start_ns, end_ns, peak, n, closed, refs): a step a sample of each series; a row's interval is the one that is opening, open, or just closed.
INTERVALS = Z + """,
samples AS MATERIALIZED (SELECT service, name, event_time AS t, abs(z) AS size, event_id AS ref, row_number() OVER (PARTITION BY service, name ORDER BY event_time, event_id) AS i FROM z WHERE z IS NOT NULL),
last_i AS MATERIALIZED (SELECT service, name, max(i) AS last FROM samples GROUP BY ALL),
hyst AS (
  SELECT service, name, i, false AS open, 0 AS leaving, CASE WHEN size >= 3 THEN 1 ELSE 0 END AS entering, false AS done, t AS start_ns, t AS end_ns, size AS peak, 1 AS n, ref AS refs FROM samples WHERE i = 1
  UNION ALL
  SELECT x.service, x.name, x.i,
    CASE WHEN h.open THEN NOT (x.size < 1.5 AND h.leaving = 1) ELSE x.size >= 3 AND h.entering = 1 END,
    CASE WHEN h.open AND x.size < 1.5 AND h.leaving = 0 THEN 1 ELSE 0 END,
    CASE WHEN NOT h.open AND x.size >= 3 AND h.entering = 0 THEN 1 ELSE 0 END,
    h.open AND x.size < 1.5 AND h.leaving = 1,
    CASE WHEN NOT h.open AND x.size >= 3 AND h.entering = 0 THEN x.t ELSE h.start_ns END,
    CASE WHEN h.open AND x.size < 1.5 THEN h.end_ns ELSE x.t END,
    CASE WHEN h.open AND x.size < 1.5 THEN h.peak WHEN h.open OR h.entering = 1 THEN greatest(h.peak, x.size) ELSE x.size END,
    CASE WHEN h.open AND x.size < 1.5 THEN h.n WHEN h.open OR h.entering = 1 THEN h.n + 1 ELSE 1 END,
    CASE WHEN h.open AND x.size < 1.5 THEN h.refs WHEN h.open OR h.entering = 1 THEN h.refs || ' ' || x.ref ELSE x.ref END
  FROM hyst h JOIN samples x ON x.service = h.service AND x.name = h.name AND x.i = h.i + 1),
iv AS MATERIALIZED (
  SELECT h.service, h.name, start_ns, end_ns, peak, n, done AS closed, refs FROM hyst h JOIN last_i USING (service, name) WHERE done OR open AND i = last)"""

_UNIT = "greatest(least({}, 1.0), 0.0)"
_SCORE = "(0.0" + "".join(f" + {n} * ({w})" for n, w in WEIGHTS.items()) + ")"

#: Features and rank of each service, and per service the arrays ``impacted`` and ``preceding``.
RANKED = f"""{INTERVALS},
{EDGES},
{REACH},
{CRITICAL},
onset AS MATERIALIZED (SELECT service, min(start_ns) AS onset_ns, max(peak) AS peak_abs_z, sum(greatest(end_ns - start_ns, 0)) AS anomalous_ns FROM iv GROUP BY service),
whole AS (SELECT min(onset_ns) AS incident_onset, count(*) AS anomalous_n, (SELECT max(end_ns) FROM iv) AS incident_end, (SELECT count(*) FROM bad) AS failed_n FROM onset),
svc AS (SELECT service FROM spans UNION SELECT peer_service FROM spans WHERE peer_service <> service UNION SELECT service FROM metrics UNION SELECT service FROM logs UNION SELECT service FROM changes),
usual AS (SELECT service, avg(contribution_ns) AS u FROM critical ANTI JOIN bad USING (trace_id) GROUP BY service),
excess AS (SELECT service, sum(greatest(contribution_ns - coalesce(u, 0.0), 0.0)) AS e FROM (SELECT * FROM critical SEMI JOIN bad USING (trace_id)) LEFT JOIN usual USING (service) GROUP BY service),
covered AS (SELECT service, count(DISTINCT trace_id) AS c FROM spans SEMI JOIN bad USING (trace_id) GROUP BY service),
hit AS (SELECT r.service, list_sort(list(DISTINCT r.caller)) AS impacted, coalesce(list_sort(list(DISTINCT r.caller) FILTER (o.onset_ns < own.onset_ns)), []) AS preceding
  FROM reach r JOIN onset o ON o.service = r.caller LEFT JOIN onset own ON own.service = r.service GROUP BY r.service),
based AS MATERIALIZED (SELECT svc.service, onset_ns, peak_abs_z, anomalous_ns, incident_onset, incident_end, anomalous_n, failed_n, coalesce(onset_ns, incident_onset) AS moment,
    (SELECT count(*) FROM svc) AS services_n, (SELECT count(*) FROM onset o WHERE o.onset_ns < onset.onset_ns) AS earlier FROM svc LEFT JOIN onset USING (service), whole),
near_changes AS (SELECT b.service, c.event_id AS ref, 1 - (b.moment - c.event_time) / 600000000000.0 AS near FROM based b JOIN changes c ON c.service = b.service AND b.moment - c.event_time BETWEEN 0 AND 600000000000),
near_logs AS (SELECT b.service, l.event_id AS ref FROM based b JOIN logs l ON l.service = b.service AND l.severity IN ('error', 'fatal') AND abs(b.moment - l.event_time) <= 60000000000),
facts AS (SELECT b.*, coalesce(impacted, []) AS impacted, coalesce(preceding, []) AS preceding, coalesce(c, 0) AS c, coalesce(e, 0) AS e, (SELECT sum(e) FROM excess) AS all_e,
    coalesce((SELECT max(near) FROM near_changes n WHERE n.service = b.service), 0.0) AS near, (SELECT count(*) FROM near_logs n WHERE n.service = b.service) AS logs_n
  FROM based b LEFT JOIN hit USING (service) LEFT JOIN covered USING (service) LEFT JOIN excess USING (service)),
feats AS (SELECT service, onset_ns, incident_onset, incident_end, moment, impacted, preceding,
    {_UNIT.format("coalesce(peak_abs_z, 0) / 8.0")} AS anomaly_strength,
    CASE WHEN onset_ns IS NULL THEN 0.0 WHEN anomalous_n <= 1 THEN 1.0 ELSE 1 - earlier / (anomalous_n - 1) END AS temporal_precedence,
    coalesce(c / nullif(failed_n, 0), 0.0) AS failed_trace_coverage, coalesce(e / nullif(all_e, 0), 0.0) AS critical_path_contribution,
    coalesce(len(impacted) / nullif(services_n - 1, 0), 0.0) AS downstream_impact,
    coalesce(len(impacted) / nullif(anomalous_n - CASE WHEN onset_ns IS NULL THEN 0 ELSE 1 END, 0), 0.0) AS topology_consistency,
    near AS change_proximity, {_UNIT.format("logs_n / 3.0")} AS log_evidence,
    CASE WHEN incident_end > incident_onset THEN {_UNIT.format("coalesce(anomalous_ns / (incident_end - incident_onset), 0.0)")} ELSE 0.0 END AS persistence,
    CASE WHEN onset_ns IS NULL THEN CASE WHEN anomalous_n > 0 THEN 1.0 ELSE 0.0 END ELSE coalesce(len(preceding) / nullif(len(impacted), 0), 0.0) END AS contradiction_penalty
  FROM facts),
scored AS (SELECT *, {_SCORE} AS score FROM feats),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, service) AS rank FROM scored)"""

def _le(c: str) -> str:
    h = f"printf('%016x', {c})"
    return "unhex(" + " || ".join(f"substr({h}, {i}, 2)" for i in range(15, 0, -2)) + ")"


_KINDS = (
    ("MetricAnomaly", "anomaly_strength", "e", "true"), ("TemporalPrecedence", "temporal_precedence", "s", "onset_ns IS NOT NULL"), ("FailedTraceCoverage", "failed_trace_coverage", "e", "true"),
    ("CriticalPathIncrease", "critical_path_contribution", "e", "true"), ("DependencyPropagation", "greatest(topology_consistency, downstream_impact)", "e", "true"),
    ("DeploymentProximity", "change_proximity", "s", "true"), ("LogTemplateSpike", "log_evidence", "e", "true"), ("Contradiction", "contradiction_penalty", "e", "true"),
)
#: (rank, service, evidence_id, type, direction, strength, start_ns, end_ns)
EVIDENCE = f"""{RANKED},
spanned AS (SELECT *, coalesce(moment, 0) AS s, coalesce(incident_end, moment, 0) AS e FROM ranked),
items AS ({" UNION ALL ".join(f"SELECT rank, service, '{k}' AS type, CASE WHEN '{k}' = 'Contradiction' THEN 'contradicts' ELSE 'supports' END AS direction, {v} AS strength, s AS start_ns, {t} AS end_ns FROM spanned WHERE {v} > 0 AND {ok}" for k, v, t, ok in _KINDS)}),
found AS (SELECT *, 'ev-' || substr(sha256(encode('all|' || service || '|' || type || '|') || {_le("start_ns")} || {_le("end_ns")}), 1, 16) AS evidence_id FROM items)"""


def _short(*parts: str) -> str:
    return "substr(sha256(" + " || '|' || ".join(parts) + "), 1, 10)"


_METRIC = "'metric:' || " + _short("service", "name", "CAST(start_ns AS VARCHAR)")
#: (id, kind, service, time_ns, strength) and (id, source, target, kind)
GRAPH = f"""{RANKED},
best AS (SELECT * FROM ranked WHERE rank <= 3),
nodes AS (
  SELECT 'deg:' || service AS id, 'ServiceDegradation' AS kind, service, onset_ns AS time_ns, anomaly_strength AS strength FROM ranked WHERE onset_ns IS NOT NULL
  UNION SELECT {_METRIC}, 'MetricAnomaly', service, start_ns, {_UNIT.format("peak / 8.0")} FROM iv
  UNION SELECT 'cand:' || service, 'RootCauseCandidate', service, onset_ns, {_UNIT.format("score")} FROM best
  UNION SELECT 'change:' || ref, 'Change', service, NULL, change_proximity FROM best JOIN near_changes USING (service)
  UNION SELECT 'log:' || ref, 'LogPattern', service, NULL, log_evidence FROM best JOIN near_logs USING (service)),
links AS (
  SELECT {_METRIC} AS source, 'deg:' || service AS target, 'ContributesTo' AS kind FROM iv
  UNION ALL SELECT 'deg:' || service, 'cand:' || service, 'ContributesTo' FROM best WHERE onset_ns IS NOT NULL
  UNION ALL SELECT 'change:' || ref, 'deg:' || service, 'Precedes' FROM best JOIN near_changes USING (service) WHERE onset_ns IS NOT NULL
  UNION ALL SELECT 'log:' || ref, 'deg:' || service, 'CorrelatesWith' FROM best JOIN near_logs USING (service) WHERE onset_ns IS NOT NULL
  UNION ALL SELECT 'deg:' || b.service, 'deg:' || o.service, 'PropagatesTo' FROM (SELECT service, onset_ns, unnest(impacted) AS other FROM best) b JOIN onset o ON o.service = b.other WHERE o.onset_ns >= b.onset_ns
  UNION ALL SELECT 'deg:' || other, 'cand:' || service, 'Contradicts' FROM (SELECT service, unnest(preceding) AS other FROM best)),
numbered AS (SELECT 'ee-' || {_short("'all'", "source", "target", "kind")} AS id, * FROM links)"""
