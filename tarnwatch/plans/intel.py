"""Queries on threat intelligence."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tarnwatch.operators import intel as I
from tarnwatch.plans.support import Book, rounded
from tarnwatch.plans.views import alerts, duck, geo_ranges, indicators, table, traffic, traffic_slow
from tarnwatch.sources import rules as SR

book = Book()
add = book.add

add("read_indicators",
    lambda s, d: SR.indicator_lines(table(s, d, "documents").select(
        F.explode(F.split("text", "\n")).alias("value")), feed=True).groupBy("value").agg(F.count("*").alias("n"))
        .select(F.md5("value").alias("line"), "n"),
    """SELECT md5(v) AS line, count(*) AS n FROM (SELECT trim(unnest(string_split(text, chr(10)))) AS v FROM documents)
      WHERE length(v) > 0 AND v[1] NOT IN ('#', ';') GROUP BY v""")

_LINE = "CASE WHEN record_id % 9 = 0 THEN '# note' WHEN record_id % 7 = 0 THEN '; off' WHEN record_id % 5 = 0 THEN source_ip || '9' ELSE ' ' || source_ip || ' ' END"
add("parse_feed_ip",
    lambda s, d: I.parse_feed(traffic(s, d).select(F.expr(_LINE.replace("||", "||")).alias("value")), "ip", "abuse_ch", ipv6=False)
    .groupBy("indicator", "indicator_type", "threat_type", "confidence", "source").agg(F.count("*").alias("n")),
    duck("traffic", f"""SELECT ind AS indicator, 'ip' AS indicator_type, 'botnet' AS threat_type, 0.8::DOUBLE AS confidence, 'abuse_ch' AS source,
      count(*) AS n FROM (SELECT trim({_LINE}) AS ind FROM traffic)
      WHERE ind NOT LIKE '#%' AND ind NOT LIKE ';%' AND CAST(split_part(ind, '.', 4) AS INT) <= 255 AND split_part(ind, '.', 4) NOT LIKE '0_%'
      GROUP BY ind"""))
_DLINE = "CASE WHEN k % 10 = 0 THEN '# x' WHEN k % 7 = 0 THEN 'bad..name' WHEN k % 11 = 0 THEN '-x.com' ELSE 'host-' || k || '.example.org' END"
add("parse_feed_domain",
    lambda s, d: I.parse_feed(traffic(s, d).select(F.expr(_DLINE).alias("value")), "domain", "other_feed")
    .groupBy("indicator", "threat_type", "confidence").agg(F.count("*").alias("n")),
    duck("traffic", f"""SELECT v AS indicator, 'unknown' AS threat_type, 0.8::DOUBLE AS confidence, count(*) AS n
      FROM (SELECT {_DLINE} AS v FROM traffic) WHERE v LIKE 'host-%' GROUP BY v"""))


def _sightings(s, d, shift):
    t = traffic(s, d)
    return t.where(F.col("record_id") % 2 == shift).select(
        F.col("source_ip").alias("indicator"), F.col("model_version").alias("source"),
        F.col("ts").alias("last_seen"), "record_id").groupBy("indicator", "source").agg(
        F.max("last_seen").alias("last_seen"), F.max_by("record_id", "last_seen").alias("record_id"))


add("upsert_indicators",
    lambda s, d: I.upsert_indicators(_sightings(s, d, 0), _sightings(s, d, 1)),
    duck("traffic", """SELECT source_ip AS indicator, model_version AS source, max(ts) AS last_seen, max_by(record_id, ts) AS record_id
      FROM traffic GROUP BY 1, 2"""))


def _feed_log(s, d):
    return traffic(s, d).where("destination_port <> 53").select(
        F.concat(F.lit("feed_"), "destination_port").alias("feed_name"), F.col("ts").alias("last_update"),
        F.when(F.col("k") % 3 == 0, "error").otherwise("ok").alias("status")).where(
        "feed_name <> 'feed_80' OR last_update < TIMESTAMP '2024-01-01 05:00:00'")


def _feeds(s, d):
    return traffic(s, d).select(F.concat(F.lit("feed_"), "destination_port").alias("feed_name")).distinct()


_FEED_LOG = """fl AS (SELECT 'feed_' || destination_port AS feed_name, ts AS last_update,
     CASE WHEN k % 3 = 0 THEN 'error' ELSE 'ok' END AS status FROM traffic
     WHERE destination_port <> 53 AND (destination_port <> 80 OR ts < TIMESTAMP '2024-01-01 05:00:00'))"""
add("feeds_due",
    lambda s, d: I.feeds_due(_feeds(s, d), _feed_log(s, d), datetime(2024, 1, 1, 11, 6), 3600),
    duck("traffic", f"""WITH {_FEED_LOG}, la AS (SELECT feed_name, max(last_update) AS last_update, max_by(status, last_update) AS status FROM fl GROUP BY 1)
      SELECT f.feed_name, la.last_update, la.status FROM (SELECT DISTINCT 'feed_' || destination_port AS feed_name FROM traffic) f
      LEFT JOIN la ON la.feed_name = f.feed_name
      WHERE la.last_update IS NULL OR epoch(TIMESTAMP '2024-01-01 11:06:00') - epoch(la.last_update) >= 3600"""))

_ALL_IPS = "SELECT source_ip AS ip FROM traffic UNION SELECT destination_ip FROM traffic"


def _ips(s, d):
    t = traffic(s, d)
    return t.select(F.explode(F.array("source_ip", "destination_ip")).alias("ip"))


_LONG = ("(CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536"
         " + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT))")
add("ip_reputation",
    lambda s, d: rounded(I.ip_reputation(_ips(s, d), indicators(s, d), geo_ranges(s, d)))
    .withColumn("threat_types", F.array_join("threat_types", ",")).withColumn("sources", F.array_join("sources", ",")),
    duck("indicators geo_ranges", f"""WITH a AS ({_ALL_IPS}), k AS (SELECT indicator, avg(confidence) AS c,
        string_agg(DISTINCT threat_type, ',' ORDER BY threat_type) AS tt, string_agg(DISTINCT source, ',' ORDER BY source) AS ss
        FROM indicators GROUP BY 1)
      SELECT ip, round(CASE WHEN c IS NULL THEN 0.0 WHEN c > 1 THEN 1.0 ELSE c END, 6) AS reputation_score, coalesce(tt, '') AS threat_types, coalesce(ss, '') AS sources,
        coalesce(contains(tt, 'tor'), FALSE) AS is_tor, g.country
      FROM a LEFT JOIN k ON k.indicator = a.ip LEFT JOIN geo_ranges g ON {_LONG} BETWEEN g.range_start AND g.range_end"""))

add("geolocate",
    lambda s, d: I.geolocate(traffic(s, d).select("record_id", "source_ip"), geo_ranges(s, d), "source_ip"),
    duck("traffic geo_ranges", f"""SELECT record_id, ip AS source_ip, country FROM (SELECT record_id, source_ip AS ip FROM traffic)
      LEFT JOIN geo_ranges ON {_LONG} BETWEEN range_start AND range_end"""))


def _typed(s, d):
    """All alerts, by the hours of their sources, so that time spans are those of the data at any scale."""
    kind = F.expr("CASE WHEN attack_type IN ('Probe','Port Scan') THEN 'scanner' WHEN attack_type IN ('DoS','DDoS') THEN 'dos'"
                  " WHEN attack_type = 'U2R' THEN 'exploit' ELSE 'other' END")
    per_hour = F.concat("source_ip", F.lit("@"), F.date_format(F.date_trunc("hour", "ts"), "dd-HH"))
    return alerts(s, d).withColumns({"attack_type": kind, "source_ip": per_hour})


_TYPED = """ev AS (SELECT record_id, ts, source_ip || '@' || strftime(date_trunc('hour', ts), '%d-%H') AS source_ip, CASE WHEN attack_type IN ('Probe','Port Scan') THEN 'scanner'
    WHEN attack_type IN ('DoS','DDoS') THEN 'dos' WHEN attack_type = 'U2R' THEN 'exploit' ELSE 'other' END AS attack_type
    FROM alerts)"""
_RECON = """SELECT 'attack_sequence' AS pattern_type, source_ip AS subject, 0.8::DOUBLE AS confidence, min(ts) AS first_detected,
    max(ts) AS last_detected, 1::BIGINT AS occurrence_count, 'Reconnaissance followed by exploitation from ' || source_ip AS description
  FROM ev GROUP BY source_ip HAVING count(*) >= 3 AND bool_or(attack_type = 'scanner') AND bool_or(attack_type IN ('dos','exploit'))"""
_HIGH = """SELECT 'behavioral' AS pattern_type, source_ip AS subject, 0.7::DOUBLE AS confidence, min(ts) AS first_detected, max(ts) AS last_detected,
    count(*) AS occurrence_count, 'High-frequency attacks from ' || source_ip AS description
  FROM ev GROUP BY source_ip HAVING count(*) > 10 AND epoch(max(ts)) - epoch(min(ts)) < {w}"""
_COORD = """SELECT 'temporal' AS pattern_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS subject, 0.9::DOUBLE AS confidence,
    date_trunc('hour', ts) AS first_detected, date_trunc('hour', ts) + INTERVAL '1' HOUR AS last_detected, count(*) AS occurrence_count,
    'Coordinated attack from ' || count(DISTINCT source_ip) || ' IPs' AS description
  FROM ev GROUP BY date_trunc('hour', ts) HAVING count(DISTINCT source_ip) > 5 AND count(*) > 20"""

add("recon_exploit_patterns", lambda s, d: I.recon_exploit_patterns(_typed(s, d)), duck("alerts", f"WITH {_TYPED} {_RECON}"))
add("recon_exploit_indicators", lambda s, d: I.recon_exploit_indicators(_typed(s, d)),
    duck("alerts", f"""WITH {_TYPED}, p AS ({_RECON}) SELECT source_ip, ts, record_id AS event_id, attack_type AS indicator FROM ev
      WHERE source_ip IN (SELECT subject FROM p) UNION ALL SELECT subject, NULL, NULL, subject FROM p"""))
add("high_frequency_patterns", lambda s, d: I.high_frequency_patterns(_typed(s, d), within_seconds=7200),
    duck("alerts", f"WITH {_TYPED} {_HIGH.format(w=7200)}"))
add("coordinated_patterns", lambda s, d: I.coordinated_patterns(_typed(s, d)), duck("alerts", f"WITH {_TYPED} {_COORD}"))
add("threat_patterns", lambda s, d: I.threat_patterns(_typed(s, d)),
    duck("alerts", f"WITH {_TYPED} {_RECON} UNION ALL {_HIGH.format(w=3600)} UNION ALL {_COORD}"))
add("threat_summary",
    lambda s, d: I.threat_summary(indicators(s, d), I.threat_patterns(_typed(s, d)), _feed_log(s, d).groupBy("feed_name").agg(
        F.max("last_update").alias("last_update"), F.max_by("status", "last_update").alias("status"))),
    duck("alerts indicators", f"""WITH {_TYPED}, {_FEED_LOG}, p AS ({_RECON} UNION ALL {_HIGH.format(w=3600)} UNION ALL {_COORD})
      SELECT 'indicator_type' AS section, indicator_type AS item, count(*) AS n, NULL::TIMESTAMP AS at FROM indicators GROUP BY 2
      UNION ALL SELECT 'threat_type', threat_type, count(*), NULL FROM indicators GROUP BY 2
      UNION ALL SELECT 'patterns', 'total', count(*), NULL FROM p
      UNION ALL SELECT 'feed', feed_name || ':' || max_by(status, last_update), 1, max(last_update) FROM fl GROUP BY feed_name"""))

QUERIES, ORACLE = book.queries, book.oracle
