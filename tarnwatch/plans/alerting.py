"""Queries on alerts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tarnwatch.functions import text
from tarnwatch.operators import alerts as A
from tarnwatch.plans.support import Book, rounded
from tarnwatch.plans.views import alerts, duck, predictions, traffic

book = Book()
add = book.add

add("should_alert", lambda s, d: A.should_alert(predictions(s, d)).select("record_id", "attack_type"),
    duck("alerts", "SELECT record_id, attack_type FROM alerts"))

add("alert_severity",
    lambda s, d: A.alert_severity(A.should_alert(predictions(s, d))).select("record_id", "severity"),
    duck("alerts", "SELECT record_id, severity FROM alerts"))

_ACTIONS = """VALUES ('DoS','Block source IP, investigate traffic patterns, check system resources'),
 ('DDoS','Activate DDoS mitigation, contact ISP, implement rate limiting'),
 ('Probe','Monitor source IP, review firewall rules, check for follow-up attacks'),
 ('R2L','Block source IP, review authentication logs, check for compromised accounts'),
 ('U2R','Isolate affected system, review privilege escalation logs, conduct forensic analysis'),
 ('Brute Force','Block source IP, review authentication policies, enable account lockout'),
 ('Port Scan','Monitor source IP, review exposed services, update firewall rules'),
 ('Malware','Isolate affected system, run antivirus scan, conduct forensic analysis')"""
_TWO = "printf('%.2f', round(CAST({x} AS DECIMAL(18,6)), 2))"
_DESC = f"""'Detected ' || attack_type || ' from ' || source_ip || ':' || source_port || ' to ' || destination_ip || ':'
   || destination_port || ' using ' || protocol || ' protocol. Confidence: ' || CAST(trunc(confidence_score * 100) AS INT)
   || '%. Packet size: ' || packet_size || ' bytes, Duration: ' || {_TWO.format(x='duration')} || 's.'"""
_SUFFIX = """CASE severity WHEN 'CRITICAL' THEN '. IMMEDIATE ACTION REQUIRED - Escalate to security team.'
   WHEN 'HIGH' THEN '. High priority - Review within 1 hour.' WHEN 'MEDIUM' THEN '. Medium priority - Review within 4 hours.'
   ELSE '. Low priority - Review during next maintenance window.' END"""
add("create_alerts",
    lambda s, d: A.create_alerts(predictions(s, d), traffic(s, d)),
    duck("alerts", f"""SELECT md5(record_id || ':' || strftime(ts, '%Y-%m-%d %H:%M:%S'))[:16] AS alert_id, record_id, ts, severity,
      attack_type, source_ip, destination_ip, confidence_score, {_DESC} AS description,
      coalesce(x.act, 'Investigate traffic, review logs, consider blocking source IP') || {_SUFFIX} AS recommended_action
      FROM alerts a LEFT JOIN ({_ACTIONS}) x(t, act) ON x.t = a.attack_type"""))

add("alert_text",
    lambda s, d: alerts(s, d).withColumn("imp", F.create_map(
        F.lit("packet_size"), F.col("packet_size") / 1000, F.lit("duration"), -F.col("duration"),
        F.lit("port"), F.col("destination_port") / 100.0, F.lit("bias"), F.lit(0.5))).select(
        "record_id", text.alert_description("imp").alias("description")),
    duck("alerts", f"""WITH imp AS (SELECT record_id, unnest(['packet_size','duration','port','bias']) AS f,
        unnest([packet_size / 1000.0, -duration, destination_port / 100.0, 0.5]::DOUBLE[]) AS v FROM alerts),
      rk AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY abs(v) DESC, f) AS r FROM imp),
      top AS (SELECT record_id, string_agg(f || ': ' || printf('%.3f', round(CAST(CAST(v AS VARCHAR) AS DECIMAL(30,18)), 3)), ', ' ORDER BY r) AS t
              FROM rk WHERE r <= 3 GROUP BY 1)
      SELECT a.record_id, {_DESC} || ' Key indicators: ' || t || '.' AS description
      FROM alerts a JOIN top ON top.record_id = a.record_id"""))

add("dedup_alerts", lambda s, d: A.dedup_alerts(alerts(s, d)).select("record_id", "source_ip", "attack_type"),
    duck("alerts", """WITH RECURSIVE al AS (SELECT record_id, source_ip, attack_type, epoch_us(ts) AS t,
        source_ip || '|' || destination_ip || '|' || attack_type AS k FROM alerts),
      ord AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, record_id) AS rn FROM al),
      walk AS (SELECT k, rn, record_id, t AS last_kept, TRUE AS kept FROM ord WHERE rn = 1
        UNION ALL SELECT o.k, o.rn, o.record_id,
          CASE WHEN o.t - w.last_kept >= 300000000 THEN o.t ELSE w.last_kept END,
          o.t - w.last_kept >= 300000000 FROM walk w JOIN ord o ON o.k = w.k AND o.rn = w.rn + 1)
      SELECT o.record_id, o.source_ip, o.attack_type FROM walk w JOIN ord o ON o.k = w.k AND o.rn = w.rn WHERE w.kept"""))

add("alert_stats",
    lambda s, d: A.alert_stats(alerts(s, d), A.dedup_alerts(alerts(s, d))),
    duck("alerts", """WITH RECURSIVE al AS (SELECT epoch_us(ts) AS t, record_id,
        source_ip || '|' || destination_ip || '|' || attack_type AS k FROM alerts),
      ord AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, record_id) AS rn FROM al),
      walk AS (SELECT k, rn, t AS last_kept, TRUE AS kept FROM ord WHERE rn = 1
        UNION ALL SELECT o.k, o.rn, CASE WHEN o.t - w.last_kept >= 300000000 THEN o.t ELSE w.last_kept END,
          o.t - w.last_kept >= 300000000 FROM walk w JOIN ord o ON o.k = w.k AND o.rn = w.rn + 1)
      SELECT 'total' AS section, 'generated' AS item, count(*) AS n FROM alerts
      UNION ALL SELECT 'total', 'deduplicated', count(*) FROM walk WHERE NOT kept
      UNION ALL SELECT 'severity', severity, count(*) FROM alerts GROUP BY 2
      UNION ALL SELECT 'type', attack_type, count(*) FROM alerts GROUP BY 2
      UNION ALL SELECT 'rules', 'active', 3"""))

add("search_alerts",
    lambda s, d: A.search_alerts(alerts(s, d), start=datetime(2024, 1, 1, 1), end=datetime(2024, 1, 1, 9),
                                 severities=["HIGH", "CRITICAL"], attack_types=["DDoS", "Malware", "U2R"],
                                 source_contains="192.168.1", min_confidence=0.75, limit=100).select(
        "record_id", "ts", "severity", "attack_type", "source_ip", "confidence_score"),
    duck("alerts", """SELECT record_id, ts, severity, attack_type, source_ip, confidence_score FROM alerts
      WHERE ts BETWEEN TIMESTAMP '2024-01-01 01:00:00' AND TIMESTAMP '2024-01-01 09:00:00'
        AND severity IN ('HIGH','CRITICAL') AND attack_type IN ('DDoS','Malware','U2R')
        AND source_ip LIKE '%192.168.1%' AND confidence_score >= 0.75 ORDER BY ts DESC, record_id LIMIT 100"""))

add("escalate_alerts",
    lambda s, d: A.escalate_alerts(alerts(s, d), window_seconds=7200).select(
        "record_id", "similar_count", "escalated", "severity"),
    duck("alerts", """SELECT record_id, c AS similar_count, c >= 3 AS escalated,
        CASE WHEN c >= 3 THEN 'CRITICAL' ELSE severity END AS severity FROM (
      SELECT *, count(*) OVER (PARTITION BY source_ip, destination_ip, attack_type ORDER BY epoch_us(ts)
        RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW) AS c FROM alerts)"""))


def _delivery_log(s, d):
    a = alerts(s, d)
    return a.withColumn("channel", F.explode(F.array(*map(F.lit, ["email", "webhook", "log"])))).select(
        F.col("record_id").alias("alert_id"), "severity", "channel",
        ((F.col("record_id") + F.length("channel")) % 3 == 0).alias("success"))


add("delivery_stats", lambda s, d: A.delivery_stats(_delivery_log(s, d)),
    duck("alerts", """WITH lg AS (SELECT record_id, severity, channel, (record_id + length(channel)) % 3 = 0 AS ok
        FROM alerts, (VALUES ('email'), ('webhook'), ('log')) c(channel)),
      pa AS (SELECT record_id, severity, CASE WHEN bool_or(ok) THEN 'sent' ELSE 'failed' END AS o FROM lg GROUP BY 1, 2)
      SELECT 'alerts' AS section, o AS item, count(*) AS n FROM pa GROUP BY o
      UNION ALL SELECT 'severity', severity || ':' || o, count(*) FROM pa GROUP BY 2
      UNION ALL SELECT 'channel', channel || ':' || CASE WHEN ok THEN 'sent' ELSE 'failed' END, count(*) FROM lg GROUP BY 2"""))


def _payload(style):
    def run(s, d):
        return A.create_alerts(predictions(s, d), traffic(s, d)).select(
            "alert_id", text.alert_payload(style).alias("payload"))
    return run


_AID = "md5(record_id || ':' || strftime(ts, '%Y-%m-%d %H:%M:%S'))[:16]"
_ACT = f"coalesce(x.act, 'Investigate traffic, review logs, consider blocking source IP') || {_SUFFIX}"
_PCT = f"{_TWO.format(x='confidence_score * 100')} || '%'"
_STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S UTC')"
_FROM = f"(SELECT a.*, {_AID} AS alert_id, {_DESC} AS descr, {_ACT} AS act FROM alerts a LEFT JOIN ({_ACTIONS}) x(t, act) ON x.t = a.attack_type)"
add("alert_payload_standard", _payload("standard"),
    duck("alerts", f"""SELECT alert_id, CAST(json_object('alert_id', alert_id, 'timestamp', strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'severity', severity, 'attack_type', attack_type,
      'source_ip', source_ip, 'destination_ip', destination_ip, 'confidence_score', confidence_score, 'description', descr, 'recommended_action', act) AS VARCHAR) AS payload FROM {_FROM}"""))
add("alert_payload_slack", _payload("slack"),
    duck("alerts", f"""SELECT alert_id, CAST(json_object('text', 'Intrusion alert - ' || severity, 'attachments', json_array(json_object(
      'color', CASE severity WHEN 'LOW' THEN 'good' WHEN 'MEDIUM' THEN 'warning' ELSE 'danger' END, 'fields', json_array("""
         + ", ".join(f"json_object('title', '{t}', 'value', {v}, 'short', {b})" for t, v, b in (
             ("Attack Type", "attack_type", "TRUE"), ("Severity", "severity", "TRUE"), ("Source IP", "source_ip", "TRUE"),
             ("Destination IP", "destination_ip", "TRUE"), ("Confidence", _PCT, "TRUE"), ("Timestamp", _STAMP, "TRUE"),
             ("Description", "descr", "FALSE"), ("Recommended Action", "act", "FALSE")))
         + f"), 'footer', 'Network security analytics', 'ts', epoch(ts)::BIGINT))) AS VARCHAR) AS payload FROM {_FROM}"))
add("alert_payload_teams", _payload("teams"),
    duck("alerts", f"""SELECT alert_id, CAST(json_object('@type', 'MessageCard', '@context', 'http://schema.org/extensions',
      'themeColor', CASE severity WHEN 'LOW' THEN '28a745' WHEN 'MEDIUM' THEN 'ffc107' WHEN 'HIGH' THEN 'fd7e14' ELSE 'dc3545' END, 'summary', 'Alert - ' || attack_type,
      'sections', json_array(json_object('activityTitle', 'Intrusion alert - ' || severity, 'activitySubtitle', attack_type || ' detected', 'facts', json_array("""
         + ", ".join(f"json_object('name', '{t}', 'value', {v})" for t, v in (
             ("Source IP", "source_ip"), ("Destination IP", "destination_ip"), ("Confidence", _PCT), ("Timestamp", _STAMP)))
         + f"), 'text', '**Description:** ' || descr || chr(10) || chr(10) || '**Recommended Action:** ' || act))) AS VARCHAR) AS payload FROM {_FROM}"))
add("alert_payload_text", _payload("text"),
    duck("alerts", f"""SELECT md5(record_id || ':' || strftime(ts, '%Y-%m-%d %H:%M:%S'))[:16] AS alert_id,
      'ALERT [' || severity || '] ' || attack_type || ' - ' || source_ip || ' -> ' || destination_ip || ' (confidence: '
      || {_TWO.format(x='confidence_score * 100')} || '%) - ' || {_DESC} AS payload FROM alerts"""))

QUERIES, ORACLE = book.queries, book.oracle
