"""Report, dashboard and monitoring queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tarnwatch.operators import monitor as M
from tarnwatch.operators import reports as R
from tarnwatch.operators.features import confidence_counts
from tarnwatch.plans.support import Book, rounded
from tarnwatch.plans.views import (alerts, alerts_slow, duck, duck_moment, geo_ranges, moment, prediction_log,
                                   predictions, predictions_slow, table, traffic)

book = Book()
add = book.add
START, END = datetime(2024, 1, 1, 2, 30), datetime(2024, 1, 1, 8, 10)
_PERIOD = "ts BETWEEN TIMESTAMP '2024-01-01 02:30:00' AND TIMESTAMP '2024-01-01 08:10:00'"

add("threats_by_type", lambda s, d: R.threats_by_type(alerts(s, d), moment(alerts(s, d), 1, 4), moment(alerts(s, d), 3, 4)),
    duck("alerts", f"SELECT attack_type, count(*) AS n FROM alerts WHERE ts BETWEEN {duck_moment('alerts', 1, 4)} AND {duck_moment('alerts', 3, 4)} GROUP BY 1"))
add("threats_by_severity", lambda s, d: R.threats_by_severity(alerts(s, d)),
    duck("alerts", "SELECT severity, count(*) AS n FROM alerts GROUP BY 1"))
for _name, _col in (("top_source_ips", "source_ip"), ("top_target_ips", "destination_ip")):
    add(_name, lambda s, d, c=_col: R.top_addresses(alerts(s, d), c),
        duck("alerts", f"SELECT {_col}, count(*) AS n FROM alerts GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10"))
add("confidence_distribution", lambda s, d: confidence_counts(alerts(s, d)),
    duck("alerts", """SELECT b.bin, count(t.record_id) AS n FROM (VALUES ('0.9-1.0', 0.9, 9.0), ('0.8-0.9', 0.8, 0.9),
      ('0.7-0.8', 0.7, 0.8), ('0.6-0.7', 0.6, 0.7), ('0.5-0.6', 0.5, 0.6), ('0.0-0.5', -1.0, 0.5)) b(bin, lo, hi)
      LEFT JOIN alerts t ON t.confidence_score >= b.lo::DOUBLE AND t.confidence_score < b.hi::DOUBLE GROUP BY b.bin"""))


def _map_text(name):
    return F.array_join(F.transform(F.array_sort(F.map_entries(name)),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


T0, T1 = datetime(2023, 12, 31, 22, 15), datetime(2024, 1, 1, 9, 5)
_MAPS = """SELECT h, coalesce(n, 0) AS total_threats, coalesce(t, '') AS threats_by_type, coalesce(s, '') AS threats_by_severity
  FROM generate_series(TIMESTAMP '2023-12-31 22:00:00', TIMESTAMP '2024-01-01 09:05:00', INTERVAL '1' HOUR) g(h)
  LEFT JOIN (SELECT date_trunc('hour', ts) AS ah, sum(c)::BIGINT AS n, string_agg(attack_type || '=' || c, ',' ORDER BY attack_type) AS t
    FROM (SELECT date_trunc('hour', ts) AS ts, attack_type, count(*) AS c FROM alerts GROUP BY 1, 2) GROUP BY 1) a ON ah = h
  LEFT JOIN (SELECT ts AS sh, string_agg(severity || '=' || c, ',' ORDER BY severity) AS s
    FROM (SELECT date_trunc('hour', ts) AS ts, severity, count(*) AS c FROM alerts GROUP BY 1, 2) GROUP BY 1) b ON sh = h"""
add("threat_timeline",
    lambda s, d: R.threat_timeline(alerts(s, d), T0, T1).select("hour", "total_threats", _map_text("threats_by_type").alias("threats_by_type"),
                                                                _map_text("threats_by_severity").alias("threats_by_severity")),
    duck("alerts", f"SELECT h AS hour, total_threats, threats_by_type, threats_by_severity FROM ({_MAPS})"))

_REPORT = f"""p AS (SELECT * FROM alerts WHERE {_PERIOD}),
 rep AS (SELECT 'type' AS section, attack_type AS item, count(*) AS n FROM p GROUP BY 2
  UNION ALL SELECT 'severity', severity, count(*) FROM p GROUP BY 2
  UNION ALL (SELECT 'source', source_ip, count(*) AS n FROM p GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10)
  UNION ALL (SELECT 'target', destination_ip, count(*) AS n FROM p GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10)
  UNION ALL SELECT 'confidence', b.bin, count(p.record_id) FROM (VALUES ('0.9-1.0', 0.9, 9.0), ('0.8-0.9', 0.8, 0.9),
      ('0.7-0.8', 0.7, 0.8), ('0.6-0.7', 0.6, 0.7), ('0.5-0.6', 0.5, 0.6), ('0.0-0.5', -1.0, 0.5)) b(bin, lo, hi)
      LEFT JOIN p ON p.confidence_score >= b.lo::DOUBLE AND p.confidence_score < b.hi::DOUBLE GROUP BY 2
  UNION ALL SELECT 'hour', strftime(h, '%Y-%m-%d %H'), count(p.record_id)
      FROM generate_series(TIMESTAMP '2024-01-01 02:00:00', TIMESTAMP '2024-01-01 08:10:00', INTERVAL '1' HOUR) g(h)
      LEFT JOIN p ON date_trunc('hour', p.ts) = h GROUP BY 2
  UNION ALL SELECT 'total', 'threats', count(*) FROM p)"""
add("threat_report", lambda s, d: R.threat_report(alerts(s, d), START, END), duck("alerts", f"WITH {_REPORT} SELECT * FROM rep"))


def _models(s, d):
    return M.prediction_performance(prediction_log(s, d)).select(
        F.col("model_version").alias("model_name"), "accuracy", F.col("f1_score").alias("f1_macro"),
        (F.col("avg_response_time_ms") / 1000).alias("inference_time"))


_PERF = """perf AS (SELECT *, right_ / sample_count::DOUBLE AS accuracy, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp)::DOUBLE END AS prec,
    CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn)::DOUBLE END AS rec FROM (
   SELECT model_version, count(*) FILTER (WHERE is_malicious AND actual_label) AS tp, count(*) FILTER (WHERE is_malicious AND NOT actual_label) AS fp,
     count(*) FILTER (WHERE NOT is_malicious AND actual_label) AS fn, count(*) FILTER (WHERE is_malicious = actual_label) AS right_,
     avg(confidence_score) AS avg_confidence, avg(response_time_ms) AS avg_response_time_ms, count(*) AS sample_count
   FROM prediction_log GROUP BY 1)),
 pf AS (SELECT *, CASE WHEN prec + rec = 0 THEN 0.0 ELSE 2 * prec * rec / (prec + rec) END AS f1_score FROM perf)"""
add("summary_report",
    lambda s, d: rounded(R.summary_report(
        R.threat_report(alerts(s, d), START, END).withColumn("report_id", F.lit("r1")), _models(s, d))),
    duck("alerts prediction_log", f"""WITH {_REPORT}, {_PERF}, m AS (SELECT count(*)::DOUBLE AS c, avg(accuracy) AS a, avg(f1_score) AS f, avg(avg_response_time_ms / 1000) AS i FROM pf),
      top AS (SELECT item, n FROM rep WHERE section = 'type' ORDER BY n DESC, item LIMIT 5)
      SELECT 'threats' AS section, 'total' AS item, n::DOUBLE AS value FROM rep WHERE section = 'total'
      UNION ALL SELECT 'threats', 'reports', 1 UNION ALL SELECT 'top_type', item, n FROM top
      UNION ALL SELECT 'severity', item, n FROM rep WHERE section = 'severity'
      UNION ALL SELECT 'models', 'model_count', c FROM m UNION ALL SELECT 'models', 'average_accuracy', round(a, 6) FROM m
      UNION ALL SELECT 'models', 'average_f1_score', round(f, 6) FROM m UNION ALL SELECT 'models', 'average_inference_time', round(i, 6) FROM m
      UNION ALL SELECT 'recommendation', 'High priority: ' || n || ' critical threats detected. Immediate investigation required.', 1 FROM rep WHERE section = 'severity' AND item = 'CRITICAL'
      UNION ALL (SELECT 'recommendation', 'Most common attack type: ' || item || ' (' || n || ' incidents). Consider targeted defenses.', 1 FROM top ORDER BY n DESC, item LIMIT 1)
      UNION ALL SELECT 'recommendation', 'Model accuracy below 90%. Consider retraining with additional data.', 1 FROM m WHERE a < 0.9
      UNION ALL SELECT 'recommendation', 'Model inference time above 100ms. Consider optimization for real-time detection.', 1 FROM m WHERE i > 0.1"""))

add("key_metrics",
    lambda s, d: rounded(R.key_metrics(alerts(s, d), datetime(2024, 1, 1, 6), datetime(2024, 1, 1, 9), F.col("record_id") % 4 == 0)),
    duck("alerts", """WITH w AS (SELECT *, ts >= TIMESTAMP '2024-01-01 06:00:00' AS now FROM alerts
        WHERE ts BETWEEN TIMESTAMP '2024-01-01 03:00:00' AND TIMESTAMP '2024-01-01 09:00:00'),
      g AS (SELECT count(*) FILTER (WHERE now) AS t1, count(*) FILTER (WHERE NOT now) AS t0,
        count(*) FILTER (WHERE now AND severity = 'CRITICAL') AS c1, count(*) FILTER (WHERE NOT now AND severity = 'CRITICAL') AS c0,
        count(DISTINCT source_ip) FILTER (WHERE now) AS s1, count(DISTINCT source_ip) FILTER (WHERE NOT now) AS s0,
        count(*) FILTER (WHERE now AND record_id % 4 = 0) AS o1, count(*) FILTER (WHERE NOT now AND record_id % 4 = 0) AS o0,
        avg(confidence_score) FILTER (WHERE now) AS mc FROM w)
      SELECT t1 AS total, c1 AS critical, round(coalesce(mc, 0), 6) AS mean_confidence, s1 AS unique_sources, o1 AS open_incidents,
        t1 - t0 AS total_delta, c1 - c0 AS critical_delta, s1 - s0 AS sources_delta, o1 - o0 AS open_delta FROM g"""))
add("timeline_by_severity", lambda s, d: R.timeline_by_severity(alerts(s, d)),
    duck("alerts", "SELECT date_trunc('hour', ts) AS hour, severity, count(*) AS n FROM alerts GROUP BY 1, 2"))
add("timeline_pivot", lambda s, d: R.timeline_pivot(alerts(s, d)),
    duck("alerts", "SELECT date_trunc('hour', ts) AS hour, " + ", ".join(
        f"count(*) FILTER (WHERE severity = '{x}') AS {x.lower()}" for x in ("LOW", "MEDIUM", "HIGH", "CRITICAL")) + " FROM alerts GROUP BY 1"))
add("source_ip_analysis", lambda s, d: rounded(R.source_ip_analysis(alerts(s, d))),
    duck("alerts", """SELECT source_ip, count(*) AS threats, round(avg(confidence_score), 6) AS mean_confidence,
      string_agg(DISTINCT attack_type, ', ' ORDER BY attack_type) AS attack_types FROM alerts GROUP BY 1"""))
add("recent_predictions", lambda s, d: R.recent_predictions(predictions(s, d), moment(predictions(s, d), 1, 1), 2, 500),
    duck("predictions", f"""SELECT * FROM predictions WHERE ts >= {duck_moment('predictions', 1, 1)} - INTERVAL '2' HOUR ORDER BY ts DESC, record_id LIMIT 500"""))

_TOPO = """ed AS (SELECT least(source_ip, destination_ip) AS a, greatest(source_ip, destination_ip) AS b, count(*) AS connections,
   sum(packet_size)::BIGINT AS bytes, string_agg(DISTINCT protocol, ',' ORDER BY protocol) AS protocols, max(ts) AS last_seen FROM traffic GROUP BY 1, 2)"""
add("network_topology", lambda s, d: R.topology_edges(traffic(s, d)), duck("traffic", f"WITH {_TOPO} SELECT * FROM ed"))
add("topology_metrics", lambda s, d: rounded(R.topology_metrics(R.topology_edges(traffic(s, d)))),
    duck("traffic", f"""WITH {_TOPO}, nd AS (SELECT a AS x FROM ed UNION SELECT b FROM ed)
      SELECT n AS nodes, e AS edges, round(2.0 * e / (n * (n - 1))::DOUBLE, 6) AS density, round(2.0 * e / n::DOUBLE, 6) AS mean_degree
      FROM (SELECT (SELECT count(*) FROM nd) AS n, (SELECT count(*) FROM ed) AS e)"""))
_LONG = ("(CAST(split_part(source_ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(source_ip, '.', 2) AS BIGINT) * 65536"
         " + CAST(split_part(source_ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(source_ip, '.', 4) AS BIGINT))")
add("country_stats", lambda s, d: R.country_stats(alerts(s, d), geo_ranges(s, d)),
    duck("alerts geo_ranges", f"""SELECT country, count(*) AS threats, count(DISTINCT source_ip) AS unique_ips FROM alerts
      JOIN geo_ranges ON {_LONG} BETWEEN range_start AND range_end GROUP BY 1 ORDER BY threats DESC, country LIMIT 10"""))


def _history(s, d):
    a = alerts_slow(s, d)
    step = F.explode(F.array(F.struct(F.lit("open").alias("status"), F.lit(0).alias("h")),
                             F.struct(F.lit("investigating").alias("status"), F.lit(2).alias("h")),
                             F.struct(F.lit("resolved").alias("status"), F.lit(9).alias("h"))))
    return a.withColumn("st", step).where("st.h = 0 OR (st.h = 2 AND record_id % 3 > 0) OR (st.h = 9 AND record_id % 3 = 2)").select(
        F.col("record_id").alias("alert_id"), F.col("st.status").alias("status"),
        F.timestamp_micros(F.unix_micros("ts") + F.col("st.h") * 3600000000 + (F.col("record_id") % 100) * 1000000).alias("ts"))


add("incident_stats", lambda s, d: rounded(R.incident_stats(_history(s, d), datetime(2024, 1, 12, 15))),
    duck("alerts_slow", """WITH h AS (SELECT record_id, ts + (h * 3600 + record_id % 100) * INTERVAL '1' SECOND AS ts, status FROM alerts_slow,
        (VALUES ('open', 0), ('investigating', 2), ('resolved', 9)) x(status, h)
        WHERE h = 0 OR (h = 2 AND record_id % 3 > 0) OR (h = 9 AND record_id % 3 = 2)),
      l AS (SELECT record_id, arg_max(status, ts) AS status, min(ts) AS o, max(ts) FILTER (WHERE status = 'resolved') AS r FROM h GROUP BY 1)
      SELECT count(*) FILTER (WHERE status = 'open') AS open, count(*) FILTER (WHERE status = 'investigating') AS investigating,
        count(*) FILTER (WHERE status = 'resolved' AND r::DATE = DATE '2024-01-12') AS resolved_today,
        round(avg((epoch_us(r) - epoch_us(o)) / 1e6 / 3600) FILTER (WHERE status = 'resolved'), 6) AS mean_resolution_hours FROM l"""))
add("confidence_histogram", lambda s, d: R.confidence_histogram(predictions(s, d)),
    duck("predictions", """SELECT is_malicious, least(floor(confidence_score * 20 / 1.0::DOUBLE)::INT, 19) AS bin, count(*) AS n FROM predictions GROUP BY 1, 2"""))
add("filter_options",
    lambda s, d: R.filter_options(alerts(s, d), START, END).select(F.array_join("severities", ",").alias("severities"),
                                                                   F.array_join("attack_types", ",").alias("attack_types"), "sources"),
    duck("alerts", f"""SELECT coalesce(string_agg(DISTINCT severity, ',' ORDER BY severity), '') AS severities, coalesce(string_agg(DISTINCT attack_type, ',' ORDER BY attack_type), '') AS attack_types,
      count(DISTINCT source_ip) AS sources FROM alerts WHERE {_PERIOD}"""))

# --- monitoring -----------------------------------------------------------------------------------

_PERF_COLS = """model_version, round(avg_confidence, 6) AS avg_confidence, round(avg_response_time_ms, 6) AS avg_response_time_ms, sample_count,
  round(accuracy, 6) AS accuracy, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1_score, 6) AS f1_score"""
add("prediction_performance", lambda s, d: rounded(M.prediction_performance(prediction_log(s, d))),
    duck("prediction_log", f"WITH {_PERF} SELECT {_PERF_COLS} FROM pf"))
NOW = datetime(2024, 1, 30)
_SLOT = "(CASE WHEN ts >= TIMESTAMP '2024-01-23 00:00:00' THEN k % 4 = 0 ELSE k % 10 = 0 END)"


def _drifting(s, d):
    """Prediction log whose accuracy drops in the last week."""
    log = prediction_log(s, d)
    worse = (F.col("ts") >= F.lit(datetime(2024, 1, 23))) & (F.col("record_id") % 3 == 0)
    return log.withColumn("actual_label", F.when(worse, ~F.col("is_malicious")).otherwise(F.col("actual_label")))


_HIST = """dl AS (SELECT * REPLACE (CASE WHEN ts >= TIMESTAMP '2024-01-23 00:00:00' AND record_id % 3 = 0 THEN NOT is_malicious ELSE actual_label END AS actual_label)
     FROM prediction_log),
  pr AS (SELECT *, right_ / sample_count::DOUBLE AS accuracy, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp)::DOUBLE END AS prec,
    CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn)::DOUBLE END AS rec FROM (
   SELECT model_version, date_trunc('{unit}', ts) AS ts, count(*) FILTER (WHERE is_malicious AND actual_label) AS tp, count(*) FILTER (WHERE is_malicious AND NOT actual_label) AS fp,
     count(*) FILTER (WHERE NOT is_malicious AND actual_label) AS fn, count(*) FILTER (WHERE is_malicious = actual_label) AS right_,
     avg(confidence_score) AS avg_confidence, avg(response_time_ms) AS avg_response_time_ms, count(*) AS sample_count
   FROM dl GROUP BY 1, 2)),
  mh AS (SELECT model_version, ts, sample_count, unnest(['accuracy','precision','recall','f1_score','avg_confidence','avg_response_time_ms']) AS metric_name,
    unnest([accuracy, prec, rec, CASE WHEN prec + rec = 0 THEN 0.0 ELSE 2 * prec * rec / (prec + rec) END, avg_confidence, avg_response_time_ms]) AS metric_value FROM pr)"""
add("performance_history", lambda s, d: rounded(M.performance_history(M.metric_history(_drifting(s, d), "day"), NOW, 10)),
    duck("prediction_log", f"""WITH {_HIST.format(unit='day')} SELECT model_version, ts, metric_name, round(metric_value, 6) AS metric_value, sample_count
      FROM mh WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'"""))
_DRIFT = """us AS (SELECT *, ts >= TIMESTAMP '2024-01-23 00:00:00' AS recent FROM mh WHERE sample_count >= least(50, (SELECT count(*) FROM prediction_log) // 200) AND ts <= TIMESTAMP '2024-01-30 00:00:00'),
  mn AS (SELECT model_version, metric_name, avg(metric_value) FILTER (WHERE recent) AS cur, avg(metric_value) FILTER (WHERE NOT recent) AS base FROM us GROUP BY 1, 2),
  rk AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY model_version, metric_name, metric_value) - 1) / 2.0::DOUBLE AS r,
     count(*) OVER (PARTITION BY model_version, metric_name, metric_value) AS t FROM us
     WINDOW w AS (PARTITION BY model_version, metric_name ORDER BY metric_value)),
  uu AS (SELECT model_version, metric_name, sum(r) FILTER (WHERE recent) AS r1, (count(*) FILTER (WHERE recent))::DOUBLE AS n1, (count(*) FILTER (WHERE NOT recent))::DOUBLE AS n2,
     sum((t * t * t - t) / t::DOUBLE) AS ties FROM rk GROUP BY 1, 2),
  zz AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sg FROM uu),
  pz AS (SELECT *, greatest((abs(u - n1 * n2 / 2) - 0.5) / sg, 0) AS z FROM zz),
  pt AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * z) AS t FROM pz),
  pv AS (SELECT *, least(2 * exp(-z * z / 2) * 0.3989422804014327::DOUBLE * t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE)))), 1.0) AS p FROM pt),
  dr AS (SELECT m.model_version, m.metric_name, cur, base, abs(cur - base) / abs(base) AS sc, u, p FROM mn m JOIN pv v ON v.model_version = m.model_version AND v.metric_name = m.metric_name
     WHERE abs(cur - base) / abs(base) > 0.1 AND p < 0.05)"""
_SEV = "CASE WHEN sc > 0.3 THEN 'critical' WHEN sc > 0.2 THEN 'high' WHEN sc > 0.1 AND cur < base THEN 'medium' ELSE 'low' END"
add("detect_drift",
    lambda s, d: rounded(M.detect_drift(M.metric_history(_drifting(s, d), "day"), NOW, min_samples=min(50, prediction_log(s, d).count() // 200)).drop("recommendation")),
    duck("prediction_log", f"""WITH {_HIST.format(unit='day')}, {_DRIFT} SELECT model_version, metric_name, round(cur, 6) AS current_value, round(base, 6) AS baseline_value,
      round(sc, 6) AS drift_score, round(u, 6) AS u, round(p, 6) AS p_value, {_SEV} AS severity FROM dr"""))


def _shifts(s, d):
    """Each hour of the history against the hour's model mean, as candidate drift rows."""
    h = M.metric_history(prediction_log(s, d), "hour").where("metric_name IN ('accuracy', 'recall')")
    return h.select("model_version", "metric_name", "ts", F.col("metric_value").alias("current_value"), F.lit(0.9).alias("baseline_value"),
                    F.abs((F.col("metric_value") - 0.9) / 0.9).alias("drift_score"),
                    F.concat_ws("/", "model_version", "metric_name", F.date_format("ts", "yyyyMMddHH")).alias("alert_id"))


_SHIFT = """sh AS (SELECT model_version, metric_name, ts, metric_value AS cur, 0.9::DOUBLE AS base, abs((metric_value - 0.9::DOUBLE) / 0.9::DOUBLE) AS sc,
     model_version || '/' || metric_name || '/' || strftime(ts, '%Y%m%d%H') AS alert_id FROM mh WHERE metric_name IN ('accuracy', 'recall'))"""
_PLAIN_HIST = _HIST.replace("CASE WHEN ts >= TIMESTAMP '2024-01-23 00:00:00' AND record_id % 3 = 0 THEN NOT is_malicious ELSE actual_label END", "actual_label")
add("drift_severity",
    lambda s, d: M.drift_severity(_shifts(s, d)).select("alert_id", "severity", "recommendation"),
    duck("prediction_log", f"""WITH {_PLAIN_HIST.format(unit='hour')}, {_SHIFT}, sv AS (SELECT *, {_SEV} AS severity FROM sh)
      SELECT alert_id, severity, CASE severity WHEN 'critical' THEN 'Immediate retraining required. ' WHEN 'high' THEN 'Schedule retraining within 24 hours. '
        WHEN 'medium' THEN 'Plan retraining within 48-72 hours. ' ELSE 'Monitor trend. ' END || metric_name || ' moved by '
        || printf('%.1f', round(CAST(CAST(sc * 100 AS VARCHAR) AS DECIMAL(30,18)), 1)) || '%.' AS recommendation FROM sv"""))
add("drift_alert_cooldown",
    lambda s, d: M.drift_alert_cooldown(_shifts(s, d).where("drift_score > 0.1")).select("alert_id", "model_version", "metric_name"),
    duck("prediction_log", f"""WITH RECURSIVE {_PLAIN_HIST.format(unit='hour')}, {_SHIFT},
      ord AS (SELECT *, epoch(ts) AS t, row_number() OVER (PARTITION BY model_version, metric_name ORDER BY ts, alert_id) AS rn FROM sh WHERE sc > 0.1),
      walk AS (SELECT model_version, metric_name, rn, t AS last_kept, TRUE AS kept FROM ord WHERE rn = 1
        UNION ALL SELECT o.model_version, o.metric_name, o.rn, CASE WHEN o.t - w.last_kept >= 86400 THEN o.t ELSE w.last_kept END, o.t - w.last_kept >= 86400
        FROM walk w JOIN ord o ON o.model_version = w.model_version AND o.metric_name = w.metric_name AND o.rn = w.rn + 1)
      SELECT alert_id, o.model_version, o.metric_name FROM walk w JOIN ord o ON o.model_version = w.model_version AND o.metric_name = w.metric_name AND o.rn = w.rn WHERE kept"""))


def _drift_alerts(s, d):
    a = M.drift_severity(_shifts(s, d).where("drift_score > 0.1"))
    return M.acknowledge(a, a.where("current_value > 0.9"))


add("recent_drift_alerts",
    lambda s, d: M.recent_drift_alerts(_drift_alerts(s, d), datetime(2024, 1, 20, 12), 24).select("alert_id", "severity", "acknowledged"),
    duck("prediction_log", f"""WITH {_PLAIN_HIST.format(unit='hour')}, {_SHIFT} SELECT alert_id, {_SEV} AS severity, cur > 0.9 AS acknowledged
      FROM sh WHERE sc > 0.1 AND ts > TIMESTAMP '2024-01-19 12:00:00'"""))
add("monitoring_summary",
    lambda s, d: M.monitoring_summary(M.metric_history(prediction_log(s, d), "day"), prediction_log(s, d), _drift_alerts(s, d), datetime(2024, 1, 20, 12)),
    duck("prediction_log", f"""WITH {_PLAIN_HIST.format(unit='hour')}, {_SHIFT}
      SELECT 'monitored_models' AS item, count(DISTINCT model_version) AS n FROM mh UNION ALL SELECT 'total_predictions', count(*) FROM prediction_log
      UNION ALL SELECT 'recent_predictions_24h', count(*) FROM prediction_log WHERE ts >= TIMESTAMP '2024-01-19 12:00:00'
      UNION ALL SELECT 'unacknowledged_' || {_SEV}, count(*) FROM sh WHERE sc > 0.1 AND NOT cur > 0.9 GROUP BY 1"""))
add("monitoring_recommendations",
    lambda s, d: M.monitoring_recommendations(
        M.prediction_performance(_drifting(s, d).where("ts >= TIMESTAMP '2024-01-23'")).withColumn("avg_response_time_ms", F.col("avg_response_time_ms") * 15),
        _drift_alerts(s, d).where("model_version = 'rf-1.1.0'")).select("model_version", F.array_join("recommendations", "|").alias("recommendations")),
    duck("prediction_log", f"""WITH {_HIST.format(unit='day')}, p AS (SELECT model_version, avg((is_malicious = actual_label)::INT) AS acc, avg(response_time_ms) * 15 AS rt,
        avg(confidence_score) AS ac, count(*) AS n FROM dl WHERE ts >= TIMESTAMP '2024-01-23 00:00:00' GROUP BY 1)
      SELECT model_version, concat_ws('|', CASE WHEN acc < 0.85 THEN 'Model accuracy is below 85%. Consider retraining.' END,
        CASE WHEN rt > 1000 THEN 'Average response time is high. Optimize the model.' END, CASE WHEN ac < 0.7 THEN 'Average confidence is low. Review training data.' END,
        CASE WHEN n < 100 THEN 'Low sample count. Collect more data before concluding.' END,
        CASE WHEN model_version = 'rf-1.1.0' THEN 'Critical performance drift detected. Immediate action required.' END) AS recommendations FROM p"""))

add("prediction_stats", lambda s, d: rounded(M.prediction_stats(predictions_slow(s, d), datetime(2024, 1, 20), 48)),
    duck("predictions_slow", """WITH p AS (SELECT * FROM predictions_slow WHERE ts >= TIMESTAMP '2024-01-18 00:00:00'),
      t AS (SELECT count(*)::DOUBLE AS n, (count(*) FILTER (WHERE is_malicious))::DOUBLE AS m, avg(processing_time_ms) AS a FROM p)
      SELECT 'total' AS section, 'total' AS item, n AS value FROM t UNION ALL SELECT 'total', 'malicious', m FROM t UNION ALL SELECT 'total', 'benign', n - m FROM t
      UNION ALL SELECT 'total', 'malicious_rate', round(m / n, 6) FROM t UNION ALL SELECT 'total', 'mean_processing_ms', round(a, 6) FROM t
      UNION ALL SELECT 'attack', attack_type, count(*) FROM p WHERE is_malicious GROUP BY 2"""))
add("threat_counters", lambda s, d: M.threat_counters(predictions(s, d)),
    duck("predictions", """SELECT 'predictions' AS metric, model_version || ':' || coalesce(attack_type, 'benign') AS label, count(*) AS n FROM predictions GROUP BY 2
      UNION ALL SELECT 'threats', attack_type || ':' || CASE WHEN confidence_score > 0.9 THEN 'HIGH' ELSE 'MEDIUM' END, count(*) FROM predictions WHERE is_malicious GROUP BY 2
      UNION ALL SELECT 'confidence_le', printf('%.1f', b / 10.0::DOUBLE), count(*) FROM predictions, generate_series(1, 10) g(b)
        WHERE confidence_score <= b / 10.0::DOUBLE GROUP BY 2"""))
_RATES = """mins AS (SELECT DISTINCT date_trunc('minute', ts) AS m FROM predictions), ends AS (SELECT DISTINCT m + i * INTERVAL '1' MINUTE AS e FROM mins, generate_series(1, 5) g(i)),
  rt AS (SELECT e AS "end", count(*) / 300.0::DOUBLE AS request_rate, (count(*) FILTER (WHERE is_malicious)) / 300.0::DOUBLE AS threat_rate,
    count(*) FILTER (WHERE is_malicious) AS threat_increase, (count(*) FILTER (WHERE is_malicious)) / count(*)::DOUBLE AS threat_ratio,
    quantile_cont(processing_time_ms::DOUBLE, 0.95) AS p95_ms FROM ends JOIN predictions ON date_trunc('minute', ts) < e AND date_trunc('minute', ts) >= e - INTERVAL '5' MINUTE GROUP BY 1)"""
add("metric_rates", lambda s, d: rounded(M.metric_rates(predictions(s, d))),
    duck("predictions", f"""WITH {_RATES} SELECT "end", round(request_rate, 6) AS request_rate, round(threat_rate, 6) AS threat_rate, threat_increase,
      round(threat_ratio, 6) AS threat_ratio, round(p95_ms, 6) AS p95_ms FROM rt"""))
add("firing_alerts", lambda s, d: rounded(M.firing_alerts(M.metric_rates(predictions(s, d)), "threat_rate", 0.21, 2)),
    duck("predictions", f"""WITH {_RATES}, o AS (SELECT "end" AS e, threat_rate AS v, epoch("end")::BIGINT // 60 - row_number() OVER (ORDER BY "end") AS s FROM rt WHERE threat_rate > 0.21)
      SELECT min(e) AS since, max(e) AS until, round(max(v), 6) AS peak, count(*) AS minutes FROM o GROUP BY s HAVING count(*) > 2"""))
add("request_quota",
    lambda s, d: M.request_quota(table(s, d, "events").withColumn("user_id", F.col("user_id") % 3).withColumn("ts", F.col("ts").cast("timestamp")), 2)
    .select("event_id", "request_no", "over_limit"),
    """SELECT event_id, n AS request_no, n > 2 AS over_limit FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id % 3, event_type,
      date_trunc('hour', ts) ORDER BY ts, event_id) AS n FROM events)""")

QUERIES, ORACLE = book.queries, book.oracle
