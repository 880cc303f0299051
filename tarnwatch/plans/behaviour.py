"""Queries on behaviour profiles, anomalies and time patterns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tarnwatch.operators import behavior as B
from tarnwatch.operators import features as X
from tarnwatch.plans.support import Book, rounded
from tarnwatch.plans.views import duck, traffic, traffic_slow

book = Book()
add = book.add
NOW = datetime(2024, 1, 30)

_OBS = """ob AS (SELECT source_ip AS entity_id, ts, record_id,
   unnest(['packet_size','destination_port','source_port','protocol_numeric','hour_of_day','day_of_week','flags_count','duration']) AS feature,
   unnest([CAST(packet_size AS DOUBLE), destination_port, source_port, CASE protocol WHEN 'TCP' THEN 6 WHEN 'UDP' THEN 17 ELSE 1 END, hour(ts), isodow(ts) - 1,
     len(string_split(flags_csv, ',')), duration]) AS value FROM traffic_slow)"""
_STATE = """st AS (SELECT entity_id, feature, count(*) AS n, sum(value) AS s, min(value) AS lo, max(value) AS hi, avg(value) AS mean,
   CASE WHEN count(*) > 1 THEN stddev_samp(value) ELSE 0 END AS std, max(ts) AS last_updated,
   avg(value) FILTER (WHERE ts >= TIMESTAMP '2024-01-29 00:00:00') AS obs FROM ob GROUP BY 1, 2)"""

add("behavior_profiles",
    lambda s, d: rounded(B.behavior_profiles(traffic_slow(s, d)).drop("sum_squares"), 6),
    duck("traffic_slow", f"""WITH {_OBS}, {_STATE} SELECT entity_id, feature, n AS count, round(s, 6) AS sum, round(lo, 6) AS min, round(hi, 6) AS max,
      round(mean, 6) AS mean, round(std, 6) AS std, last_updated FROM st"""))
add("behavior_profiles_merged",
    lambda s, d: rounded(B.finish(B.merge_parts([
        B.profile_parts(B.observations(traffic_slow(s, d).where("record_id % 3 = 0"))),
        B.profile_parts(B.observations(traffic_slow(s, d).where("record_id % 3 <> 0")))])).drop("sum_squares"), 6),
    duck("traffic_slow", f"""WITH {_OBS}, {_STATE} SELECT entity_id, feature, n AS count, round(s, 6) AS sum, round(lo, 6) AS min, round(hi, 6) AS max,
      round(mean, 6) AS mean, round(std, 6) AS std, last_updated FROM st"""))
add("baselines",
    lambda s, d: rounded(B.baselines(B.behavior_profiles(traffic_slow(s, d)), 100, ["192.168.0.0"])),
    duck("traffic_slow", """SELECT source_ip AS entity_id, count(*) AS observation_count, max(ts) AS last_updated,
      CASE WHEN source_ip = '192.168.0.0' THEN 1.0 ELSE round(least(count(*) / 100.0::DOUBLE, 1.0), 6) END::DOUBLE AS confidence_score,
      source_ip = '192.168.0.0' OR count(*) >= 100 AS baseline_established FROM traffic_slow GROUP BY 1"""))


def _shifted(s, d):
    """Traffic whose packets of the last day grow for some sources."""
    t = traffic_slow(s, d)
    grown = (F.col("ts") >= F.lit(datetime(2024, 1, 29))) & (F.col("record_id") % 2 == 0)
    return t.withColumn("packet_size", F.when(grown, F.col("packet_size") * 8).otherwise(F.col("packet_size")))


_SHIFT = "ob2 AS (SELECT * REPLACE (CASE WHEN feature = 'packet_size' AND ts >= TIMESTAMP '2024-01-29 00:00:00' AND record_id % 2 = 0 THEN value * 8 ELSE value END AS value) FROM ob)"
_Z = f"""{_OBS}, {_SHIFT}, {_STATE.replace('FROM ob ', 'FROM ob2 ')},
  z AS (SELECT *, abs(obs - mean) / std AS z FROM st WHERE n >= 60 AND std > 0 AND obs IS NOT NULL),
  an AS (SELECT *, CASE WHEN z > 4 THEN 'critical' WHEN z > 3 THEN 'high' ELSE 'medium' END AS severity FROM z WHERE z > 2)"""
_REC = """CASE severity WHEN 'critical' THEN 'Immediate investigation required. Potential security incident.'
  WHEN 'high' THEN 'Investigate within 1 hour. Monitor closely.' ELSE 'Monitor trend. Investigate if pattern continues.' END"""


def _zscores(s, d):
    return B.zscore_anomalies(_shifted(s, d), NOW, min_obs=60)


add("zscore_anomalies",
    lambda s, d: rounded(_zscores(s, d).drop("description"), 6),
    duck("traffic_slow", f"""WITH {_Z} SELECT md5(entity_id || '_' || feature || '_2024-01-30T00:00:00')[:16] AS anomaly_id, entity_id, feature,
      'statistical_deviation' AS anomaly_type, severity, round(least(z / 5, 1.0), 6) AS anomaly_score, round(mean, 6) AS baseline_value,
      round(obs, 6) AS observed_value, round(z, 6) AS z_score, {_REC} AS recommended_action FROM an"""))
add("isolation_forest_anomalies",
    lambda s, d: B.isolation_forest_anomalies(traffic_slow(s, d), NOW, 24 * 7).select("entity_id", "record_id", "severity"))

_SCOPE = "sc AS (SELECT *, source_ip AS entity_id FROM traffic_slow WHERE ts BETWEEN TIMESTAMP '2024-01-23 00:00:00' AND TIMESTAMP '2024-01-30 00:00:00'), big AS (SELECT entity_id FROM sc GROUP BY 1 HAVING count(*) >= 24)"
_FEW = _SCOPE.replace(">= 24", ">= greatest(least((SELECT count(*) FROM traffic_slow) // 416, 24), 2)")


def _patterns(s, d, kind):
    """Patterns of sources with 24 rows a week, fewer where the table has few rows a source."""
    t = traffic_slow(s, d)
    return B.traffic_patterns(t, kind, NOW, min_rows=max(min(t.count() // 416, 24), 2))


_KIND = {
    "hourly": """ser AS (SELECT b.entity_id, h AS idx, h AS bucket, coalesce(avg(packet_size), 0) AS m FROM big b, generate_series(0, 23) g(h)
        LEFT JOIN sc ON sc.entity_id = b.entity_id AND hour(sc.ts) = h GROUP BY 1, 2)""",
    "weekly": """ser AS (SELECT b.entity_id, h AS idx, h AS bucket, coalesce(avg(packet_size), 0) AS m FROM big b, generate_series(0, 6) g(h)
        LEFT JOIN sc ON sc.entity_id = b.entity_id AND isodow(sc.ts) - 1 = h GROUP BY 1, 2)""",
    "daily": """ser AS (SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY dy) - 1 AS idx, dy AS bucket, m FROM (
        SELECT entity_id, ts::DATE - DATE '1970-01-01' AS dy, avg(packet_size) AS m FROM sc WHERE entity_id IN (SELECT entity_id FROM big) GROUP BY 1, 2))""",
}
_PAT = """lg AS (SELECT *, lag(m) OVER (PARTITION BY entity_id ORDER BY idx) AS l FROM ser),
  ps AS (SELECT entity_id, count(*) AS points, avg(m) AS mean, stddev_pop(m) AS std, min(m) AS lo, max(m) AS hi,
     arg_max(bucket, m * 1000000 - idx) AS peak, arg_min(bucket, m * 1000000 + idx) AS low, corr(m, l) AS r, coalesce(regr_slope(m, idx), 0) AS slope FROM lg GROUP BY 1),
  pt AS (SELECT *, points >= 4 AND std > 0 AND coalesce(abs(r) > 0.5, FALSE) AS seasonality,
     CASE WHEN points < 3 THEN 'stable' WHEN slope > 0.1 THEN 'increasing' WHEN slope < -0.1 THEN 'decreasing' ELSE 'stable' END AS trend FROM ps)"""
for _k, _sql in _KIND.items():
    add(f"{_k}_pattern",
        lambda s, d, k=_k: rounded(_patterns(s, d, k).withColumns(
            {"peak": F.col("peak").cast("long"), "low": F.col("low").cast("long")}), 6),
        duck("traffic_slow", f"""WITH {_FEW}, {_sql}, {_PAT} SELECT entity_id, points, round(mean, 6) AS mean, round(std, 6) AS std, round(lo, 6) AS min, round(hi, 6) AS max,
          peak::BIGINT AS peak, low::BIGINT AS low, round(slope, 6) AS slope, seasonality, trend, '{_k}' AS pattern_type FROM pt"""))
add("seasonality", lambda s, d: _patterns(s, d, "daily").select("entity_id", "seasonality"),
    duck("traffic_slow", f"WITH {_FEW}, {_KIND['daily']}, {_PAT} SELECT entity_id, seasonality FROM pt"))
add("trend", lambda s, d: rounded(_patterns(s, d, "daily").select("entity_id", "slope", "trend"), 6),
    duck("traffic_slow", f"WITH {_FEW}, {_KIND['daily']}, {_PAT} SELECT entity_id, round(slope, 6) AS slope, trend FROM pt"))
add("pattern_anomalies",
    lambda s, d: B.pattern_anomalies(_patterns(s, d, "daily")),
    duck("traffic_slow", f"""WITH {_FEW}, {_KIND['daily']}, {_PAT} SELECT entity_id, 'daily' AS pattern_type, 'pattern_deviation' AS anomaly_type, 'medium' AS severity,
      0.7::DOUBLE AS anomaly_score, 'Pattern anomaly detected in daily traffic pattern' AS description, 'Review traffic patterns during next analysis cycle.' AS recommended_action
      FROM pt WHERE std > 2 * mean OR (trend = 'increasing' AND slope > 10)"""))
add("anomaly_severity",
    lambda s, d: traffic(s, d).select("record_id", B.z_severity(F.col("k") / 20.0).alias("z_severity"),
                                      B.ml_severity(F.col("confidence_score")).alias("ml_severity"),
                                      B.recommendation(B.ml_severity(F.col("confidence_score")), "ml_anomaly").alias("action")),
    duck("traffic", """SELECT record_id, CASE WHEN k / 20.0 > 4 THEN 'critical' WHEN k / 20.0 > 3 THEN 'high' WHEN k / 20.0 > 2 THEN 'medium' ELSE 'low' END AS z_severity,
      ms AS ml_severity, CASE ms WHEN 'critical' THEN 'High-confidence anomaly detected. Escalate to security team.' WHEN 'high' THEN 'Review anomaly details and correlate with other events.'
        WHEN 'medium' THEN 'Log for trend analysis. Consider baseline adjustment.' ELSE 'Low-confidence anomaly. Monitor for recurring patterns.' END AS action
      FROM (SELECT *, CASE WHEN confidence_score > 0.8::DOUBLE THEN 'critical' WHEN confidence_score > 0.6::DOUBLE THEN 'high' WHEN confidence_score > 0.4::DOUBLE THEN 'medium' ELSE 'low' END AS ms FROM traffic)"""))


def _summary(s, d):
    t = traffic_slow(s, d)
    return B.behavior_summary(B.baselines(B.behavior_profiles(t), 100), _zscores(s, d), B.traffic_patterns(t, "daily", NOW))


_SUM = f"""{_Z}, {_SCOPE}, {_KIND['daily']}, {_PAT},
  bl AS (SELECT source_ip AS entity_id, count(*) AS observation_count, least(count(*) / 100.0::DOUBLE, 1.0) AS conf FROM traffic_slow GROUP BY 1),
  ac AS (SELECT entity_id, count(*) AS a, count(*) FILTER (WHERE severity = 'critical') AS c, count(*) FILTER (WHERE severity = 'high') AS h FROM an GROUP BY 1),
  su AS (SELECT bl.*, coalesce(a, 0) AS a, coalesce(c, 0) AS c, coalesce(h, 0) AS h, trend, coalesce(trend = 'increasing', FALSE) AS rising, coalesce(seasonality, FALSE) AS seasonal
     FROM bl LEFT JOIN ac ON ac.entity_id = bl.entity_id LEFT JOIN pt ON pt.entity_id = bl.entity_id)"""
add("behavior_summary",
    lambda s, d: rounded(_summary(s, d).select("entity_id", "observation_count", "confidence_score", "baseline_established", "anomalies", "critical", "high",
                                               "rising", "seasonal", F.col("patterns")[0]["trend"].alias("trend"))),
    duck("traffic_slow", f"""WITH {_SUM} SELECT entity_id, observation_count, round(conf, 6) AS confidence_score, observation_count >= 100 AS baseline_established, a AS anomalies,
      c AS critical, h AS high, rising, seasonal, trend FROM su"""))
add("behavior_recommendations",
    lambda s, d: B.behavior_recommendations(_summary(s, d)).select("entity_id", F.array_join("recommendations", "|").alias("recommendations")),
    duck("traffic_slow", f"""WITH {_SUM} SELECT entity_id, concat_ws('|',
      CASE WHEN observation_count < 100 THEN 'Baseline not established. Need ' || (100 - observation_count) || ' more observations.' END,
      CASE WHEN c > 0 THEN 'Critical anomalies detected (' || c || '). Immediate investigation required.' END,
      CASE WHEN h > 0 THEN 'High severity anomalies detected (' || h || '). Review within 1 hour.' END,
      CASE WHEN rising THEN 'Increasing traffic trends detected. Monitor for capacity issues.' END,
      CASE WHEN seasonal THEN 'Seasonal patterns detected. Consider time-based alerting rules.' END) AS recommendations FROM su"""))
add("behavior_vector_open",
    lambda s, d: rounded(X.behavior_features(traffic(s, d)).select("record_id", F.size("behavior").alias("n"),
                                                                   F.element_at("behavior", "k_value").alias("k_value"))),
    duck("traffic", "SELECT record_id, 10 AS n, k::DOUBLE AS k_value FROM traffic"))

QUERIES, ORACLE = book.queries, book.oracle
