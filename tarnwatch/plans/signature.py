"""Queries on signature rules and hybrid detection."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tarnwatch.operators import signatures as S
from tarnwatch.plans.support import Book, rounded
from tarnwatch.plans.views import duck, indicators, traffic

book = Book()
add = book.add
R = S.SignatureRule

RULES = [
    R("c1", "Web from office", "HIGH", "custom", json.dumps(
        {"source_ip": "192.168.1.0/24", "destination_port": [80, 443], "protocol": "tcp"})),
    R("c2", "Mid sized", "LOW", "custom", json.dumps(
        {"packet_size": {"min": 1000, "max": 2000}, "source_port": {"min": 20000},
         "features": {"k_value": {"min": 10, "max": 60}, "absent": 5}})),
    R("c3", "Listed hosts", "CRITICAL", "custom", json.dumps(
        {"source_ip": ["192.168.0.4", "192.168.2.6"], "features": {"k_value": 42}})),
    R("s1", "Mail relay", "MEDIUM", "suricata", 'alert tcp $OFFICE any -> $RELAY :25 (msg:"mail leaves the office";)'),
    R("s2", "Datagrams", "HIGH", "suricata", 'alert udp $OFFICE any -> $WORLD any (content:"k_value: 31"; classtype:demo;)'),
    R("s3", "Any protocol content", "LOW", "suricata", 'alert ip any any -> any any (content:"k_value: 7";)'),
    R("n1", "Flood", "MEDIUM", "snort", 'alert tcp any any -> any any (msg:"looks like a dos flood"; rev:7;)'),
    R("n2", "Quick probes", "HIGH", "snort", 'alert udp any any -> any any (msg:"burst of scanning probes"; rev:1;)'),
    R("y1", "Hosts", "MEDIUM", "yara", 'rule a { strings: $a = "10.0.0.7:53" $b = "192.168.3.11" condition: $a and $b }'),
    R("y2", "Large", "LOW", "yara", "rule b { condition: filesize > 9000 }"),
    R("y3", "Disabled", "LOW", "yara", "rule c { condition: filesize > 1 }", enabled=False),
]

_M = """marked AS (SELECT t.*, (t.source_ip IN (SELECT indicator FROM indicators)
          OR t.destination_ip IN (SELECT indicator FROM indicators)) AS bad FROM traffic t),
m AS (
  SELECT 0 AS ord, 's1' AS rule_id, 'Mail relay' AS name, 'MEDIUM' AS severity, 'suricata' AS family, record_id FROM marked
    WHERE protocol = 'TCP' AND (bad OR source_port = 25 OR destination_port = 25)
  UNION ALL SELECT 1, 's2', 'Datagrams', 'HIGH', 'suricata', record_id FROM marked WHERE protocol = 'UDP'
  UNION ALL SELECT 2, 's3', 'Any protocol content', 'LOW', 'suricata', record_id FROM marked
    WHERE bad OR CAST(k AS STRING) LIKE '7%'
  UNION ALL SELECT 3, 'n1', 'Flood', 'MEDIUM', 'snort', record_id FROM marked
    WHERE protocol = 'TCP' AND (packet_size > 10000 OR packet_size > 5000 OR (source_port < 1024 AND destination_port < 1024))
  UNION ALL SELECT 4, 'n2', 'Quick probes', 'HIGH', 'snort', record_id FROM marked
    WHERE protocol = 'UDP' AND (packet_size > 10000 OR (source_port < 1024 AND destination_port < 1024) OR duration < 0.01)
  UNION ALL SELECT 5, 'y1', 'Hosts', 'MEDIUM', 'yara', record_id FROM marked
    WHERE contains(source_ip || ':' || source_port || '->' || destination_ip || ':' || destination_port, '10.0.0.7:53')
       OR contains(source_ip || ':' || source_port, '192.168.3.11')
  UNION ALL SELECT 6, 'y2', 'Large', 'LOW', 'yara', record_id FROM marked WHERE packet_size > 9000
  UNION ALL SELECT 7, 'c1', 'Web from office', 'HIGH', 'custom', record_id FROM marked
    WHERE source_ip LIKE '192.168.1.%' AND destination_port IN (80, 443) AND protocol = 'TCP'
  UNION ALL SELECT 8, 'c2', 'Mid sized', 'LOW', 'custom', record_id FROM marked
    WHERE packet_size BETWEEN 1000 AND 2000 AND source_port >= 20000 AND k BETWEEN 10 AND 60
  UNION ALL SELECT 9, 'c3', 'Listed hosts', 'CRITICAL', 'custom', record_id FROM marked
    WHERE source_ip IN ('192.168.0.4', '192.168.2.6') AND k = 42)"""

for _family in S.FAMILIES:
    add(f"match_{_family}",
        lambda s, d, f=_family: S.signature_matches(traffic(s, d), RULES, indicators(s, d), f).select("record_id", "rule_id"),
        duck("traffic indicators", f"WITH {_M} SELECT record_id, rule_id FROM m WHERE family = '{_family}'"))

add("signature_matches",
    lambda s, d: S.signature_matches(traffic(s, d), RULES, indicators(s, d)),
    duck("traffic indicators", f"WITH {_M} SELECT record_id, ord, rule_id, name, severity, family FROM m"))

_SCORE = """sc AS (SELECT record_id, avg(CASE severity WHEN 'LOW' THEN 0.2::DOUBLE WHEN 'MEDIUM' THEN 0.5 WHEN 'HIGH' THEN 0.8 ELSE 1.0 END) AS s,
    bool_or(severity = 'CRITICAL') AS crit, count(*) AS c,
    string_agg(name, ', ' ORDER BY ord) FILTER (WHERE r <= 3) AS names
  FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ord) AS r FROM m) GROUP BY 1),
v AS (SELECT t.*, coalesce(s, 0.0) AS sig, coalesce(crit, FALSE) AS crit, coalesce(c, 0) AS c, names,
    (CASE WHEN is_malicious THEN confidence_score ELSE 1 - confidence_score END) * 0.7::DOUBLE + coalesce(s, 0.0) * 0.3::DOUBLE AS comb
  FROM traffic t LEFT JOIN sc ON sc.record_id = t.record_id),
vd AS (SELECT *, CASE WHEN crit OR comb >= 0.8::DOUBLE THEN 'MALICIOUS' WHEN comb >= 0.5::DOUBLE THEN 'SUSPICIOUS' ELSE 'BENIGN' END AS verdict,
    CASE WHEN crit OR comb >= 0.9::DOUBLE THEN 'CRITICAL' WHEN comb >= 0.8::DOUBLE THEN 'HIGH' WHEN comb >= 0.6::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS threat_level,
    CASE WHEN crit OR comb >= 0.8::DOUBLE THEN 'Block immediately' WHEN comb >= 0.6::DOUBLE THEN 'Investigate and monitor'
         WHEN comb >= 0.5::DOUBLE THEN 'Monitor closely' ELSE 'Allow' END AS action FROM v)"""


def _detected(s, d):
    return S.detect(traffic(s, d), RULES, indicators(s, d))


add("signature_score",
    lambda s, d: rounded(S.with_matches(traffic(s, d), RULES, indicators(s, d)).select(
        "record_id", S.score_column().alias("signature_score"))),
    duck("traffic indicators", f"WITH {_M}, {_SCORE} SELECT record_id, round(sig, 6) AS signature_score FROM v"))

add("hybrid_verdict",
    lambda s, d: rounded(_detected(s, d).select("record_id", "combined_score", "verdict", "threat_level",
                                                "detection_action")),
    duck("traffic indicators", f"""WITH {_M}, {_SCORE} SELECT record_id, round(comb, 6) AS combined_score, verdict,
      threat_level, action AS detection_action FROM vd"""))

add("detection_alerts",
    lambda s, d: rounded(S.detection_alerts(_detected(s, d))),
    duck("traffic indicators", f"""WITH {_M}, {_SCORE}
      SELECT md5(source_ip || ':' || destination_ip || ':' || strftime(ts, '%Y-%m-%d %H:%M:%S'))[:16] AS alert_id, record_id, ts,
        threat_level AS severity, coalesce(attack_type, 'Unknown') AS attack_type, source_ip, destination_ip,
        round(comb, 6) AS confidence_score,
        CASE WHEN concat_ws('; ', a, b) = '' THEN 'Hybrid detection triggered' ELSE concat_ws('; ', a, b) END AS description,
        action AS recommended_action
      FROM (SELECT *, CASE WHEN is_malicious THEN 'ML detected ' || coalesce(attack_type, 'Unknown') || ' (confidence: '
          || printf('%.2f', confidence_score) || ')' END AS a,
        CASE WHEN c > 0 THEN 'Signature matches: ' || names END AS b FROM vd) WHERE verdict <> 'BENIGN'"""))

add("detection_stats",
    lambda s, d: S.detection_stats(_detected(s, d), RULES, 4),
    duck("traffic indicators", f"""WITH {_M}, {_SCORE}
      SELECT 'detections' AS section, 'total' AS item, count(*) AS n FROM vd
      UNION ALL SELECT 'detections', 'ml', count(*) FROM vd WHERE is_malicious
      UNION ALL SELECT 'detections', 'signature', count(*) FROM vd WHERE c > 0
      UNION ALL SELECT 'detections', 'hybrid', count(*) FROM vd WHERE c > 0
      UNION ALL SELECT 'matches', f.family, count(m.record_id) FROM (VALUES ('suricata'), ('snort'), ('yara'), ('custom')) f(family)
        LEFT JOIN m ON m.family = f.family GROUP BY 2
      UNION ALL SELECT * FROM (VALUES ('rules', 'suricata', 3), ('rules', 'snort', 2), ('rules', 'yara', 3), ('rules', 'custom', 3),
        ('rules', 'total', 11), ('indicators', 'ip', 4))"""))

add("indicator_hits",
    lambda s, d: S.indicator_hits(traffic(s, d), indicators(s, d)).select("record_id", "source_ip"),
    duck("traffic indicators", """SELECT record_id, source_ip FROM traffic WHERE source_ip IN (SELECT indicator FROM indicators)
      OR destination_ip IN (SELECT indicator FROM indicators)"""))
add("indicator_clean",
    lambda s, d: S.indicator_hits(traffic(s, d), indicators(s, d), clean=True).select("record_id", "source_ip"),
    duck("traffic indicators", """SELECT record_id, source_ip FROM traffic WHERE source_ip NOT IN (SELECT indicator FROM indicators)
      AND destination_ip NOT IN (SELECT indicator FROM indicators)"""))

QUERIES, ORACLE = book.queries, book.oracle
