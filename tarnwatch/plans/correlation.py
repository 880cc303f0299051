"""Queries on attack correlation.

Sequences and campaigns with an SQL twin use a plain grouping (source and
three-hour slot; subnet) as membership, so every scoring step can be compared.
The component-based membership itself is registered without SQL and is tested
against brute force.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tarnwatch.operators import alerts as A
from tarnwatch.operators import correlate as C
from tarnwatch.plans.support import Book, rounded
from tarnwatch.plans.views import alerts, duck, events, few_sources, predictions, traffic
from tarnwatch.session import cut, kept_table

book = Book()
add = book.add
RULE = {r.rule_id: r for r in C.DEFAULT_RULES}
RECON, MULTI, COORD = (RULE[n] for n in ("reconnaissance_to_exploitation", "multi_stage_attack", "coordinated_attack"))
NOW = datetime(2024, 1, 1, 11, 10)


def _text(name):
    return F.array_join(F.transform(name, lambda x: x.cast("string")), ",").alias(name)


add("correlated_events",
    lambda s, d: C.correlated_events(A.create_alerts(predictions(s, d), traffic(s, d)), predictions(s, d), traffic(s, d)).select(
        "event_id", "stage", "stage_idx", "sev_idx", "event_data.protocol", "event_data.model_version", "event_data.packet_size"),
    duck("corr_events", "SELECT event_id, stage, stage_idx, sev_idx, protocol, model_version, packet_size FROM corr_events"))
add("attack_graph_edges", lambda s, d: C.attack_edges(events(s, d)),
    duck("corr_events", """SELECT source_ip, destination_ip, arg_max(attack_type, ts) AS attack_type, arg_max(confidence_score, ts) AS confidence_score,
      arg_max(stage, ts) AS stage, max(ts) AS ts FROM corr_events GROUP BY 1, 2"""))
add("attack_graph_nodes", lambda s, d: C.attack_nodes(events(s, d)),
    duck("corr_events", """SELECT ip, arg_max(role, o) AS role, max(ts) AS last_seen FROM (SELECT source_ip AS ip, 'source' AS role, ts, epoch(ts) * 2 AS o FROM corr_events
      UNION ALL SELECT destination_ip, 'target', ts, epoch(ts) * 2 + 1 FROM corr_events) GROUP BY 1"""))

_PAIR = """SELECT a.event_id AS anchor, b.event_id AS cand, b.ts, b.source_ip, b.attack_type, b.stage_idx, b.sev_idx, a.attack_type AS anchor_type
   FROM corr_events a JOIN corr_events b ON a.{key} = b.{key} AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL '{w}' SECOND"""
for _r in (RECON, MULTI, COORD):
    _key = "source_ip" if _r.same_source else "destination_ip"
    _n = "CASE WHEN count(DISTINCT source_ip) > 1 THEN count(*) - 1 ELSE 0 END" if _r.multiple_sources else "count(*) - 1"
    add(f"rule_candidates_{_r.rule_id}", lambda s, d, r=_r: C.rule_candidates(events(s, d), r),
        duck("corr_events", f"""WITH p AS ({_PAIR.format(key=_key, w=_r.window_seconds)}) SELECT anchor AS event_id, '{_r.rule_id}' AS rule_id,
          {_n} AS candidates, count(DISTINCT source_ip) > 1 AS multiple_sources FROM p GROUP BY 1"""))

_SEQ = f"""p AS ({_PAIR.format(key='source_ip', w=7200)}),
  m1 AS (SELECT anchor, min(cand) AS a FROM p WHERE attack_type = 'Probe' GROUP BY 1),
  m2 AS (SELECT p.anchor, min(cand) AS b FROM p JOIN m1 ON m1.anchor = p.anchor WHERE attack_type = 'Port Scan' AND cand > a GROUP BY 1),
  m3 AS (SELECT p.anchor, min(cand) AS c FROM p JOIN m2 ON m2.anchor = p.anchor WHERE attack_type = 'Brute Force' AND cand > b GROUP BY 1),
  sq AS (SELECT m1.anchor, a, b, c FROM m1 JOIN m2 ON m2.anchor = m1.anchor JOIN m3 ON m3.anchor = m1.anchor)"""
add("match_sequence", lambda s, d: C.match_sequence(events(s, d), RECON).select("event_id", _text("matched")),
    duck("corr_events", f"WITH {_SEQ} SELECT anchor AS event_id, a || ',' || b || ',' || c AS matched FROM sq"))

_PROG = """SELECT event_id, source_ip, {x} FROM (SELECT *, count(*) OVER (PARTITION BY source_ip) AS n FROM (
  SELECT *, max({x}) OVER (PARTITION BY source_ip ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM corr_events)
  WHERE seen IS NULL OR {x} >= seen) WHERE n >= 2"""
add("kill_chain_progression", lambda s, d: C.kill_chain_progression(events(s, d)).select("event_id", "source_ip", "stage_idx"),
    duck("corr_events", _PROG.format(x="stage_idx")))
add("escalating_severity", lambda s, d: C.escalating_severity(events(s, d)).select("event_id", "source_ip", "sev_idx"),
    duck("corr_events", _PROG.format(x="sev_idx")))
add("similar_attack_type",
    lambda s, d: events(s, d).withColumn("g", C.similar_group("attack_type")).select("event_id", "attack_type", F.col("g").alias("similar_group"),
                                                                                    (F.col("g") == C.similar_group(F.lit("Port Scan"))).alias("like_scan")),
    duck("corr_events", """SELECT event_id, attack_type, g AS similar_group, g = 'Probe' AS like_scan FROM (SELECT *, CASE attack_type WHEN 'DDoS' THEN 'DoS'
      WHEN 'Port Scan' THEN 'Probe' WHEN 'Brute Force' THEN 'R2L' ELSE attack_type END AS g FROM corr_events)"""))

_ACC = """SELECT anchor, cand FROM (SELECT *, count(*) OVER (PARTITION BY anchor) AS n FROM (
   SELECT *, max({x}) OVER (PARTITION BY anchor ORDER BY cand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM p6)
   WHERE seen IS NULL OR {x} >= seen) WHERE n >= 2"""
_SIM = "CASE {c} WHEN 'DDoS' THEN 'DoS' WHEN 'Port Scan' THEN 'Probe' WHEN 'Brute Force' THEN 'R2L' ELSE {c} END"
_RULES = f"""{_SEQ}, p6 AS ({_PAIR.format(key='source_ip', w=21600)}), pc AS ({_PAIR.format(key='destination_ip', w=1800)}),
  ok AS (SELECT anchor FROM pc GROUP BY 1 HAVING count(DISTINCT source_ip) > 1),
  un AS (SELECT 'reconnaissance_to_exploitation' AS rule_id, anchor, unnest([a, b, c, anchor]) AS e, 2 AS mn, 10 AS mx FROM sq
    UNION SELECT 'multi_stage_attack', anchor, cand, 3, 20 FROM ({_ACC.format(x='stage_idx')})
    UNION SELECT 'multi_stage_attack', anchor, cand, 3, 20 FROM ({_ACC.format(x='sev_idx')})
    UNION SELECT 'multi_stage_attack', event_id, event_id, 3, 20 FROM corr_events
    UNION SELECT 'coordinated_attack', anchor, cand, 3, 50 FROM pc WHERE {_SIM.format(c='attack_type')} = {_SIM.format(c='anchor_type')}
      AND anchor IN (SELECT anchor FROM ok)),
  rk AS (SELECT *, row_number() OVER (PARTITION BY rule_id, anchor ORDER BY e DESC) AS r FROM un),
  ma AS (SELECT rule_id, anchor, string_agg(e, ',' ORDER BY e) AS matched FROM rk WHERE r <= mx GROUP BY rule_id, anchor, mn HAVING count(*) >= mn)"""
add("apply_rules", lambda s, d: C.apply_rules(events(s, d)).select("event_id", "rule_id", _text("matched")),
    duck("corr_events", f"WITH {_RULES} SELECT anchor AS event_id, rule_id, matched FROM ma"))

# --- component-based membership ---------------------------------------------------------------


def found_members(s, d, rules=(RECON,)):
    found = events(s, d)
    few = few_sources(s.read.schema(found.schema).parquet(kept_table(found, "events")))  # read by every rule
    return cut(C.sequence_members(C.apply_rules(few, rules), few))


def found_campaigns(s, d):
    m = found_members(s, d)
    seq = cut(C.describe_sequences(m))
    return m, seq, C.group_campaigns(C.sequence_similarity(seq, m))


def _built(s, d):
    m, seq, camp = found_campaigns(s, d)
    return rounded(C.build_campaigns(cut(camp), seq, m))


_FOUND = f"""{_SEQ.replace("corr_events", "few_events")}, mt AS (SELECT * FROM sq), lk AS (SELECT a AS x, b AS y FROM mt UNION SELECT b, c FROM mt UNION SELECT c, anchor FROM mt),
  bi AS (SELECT x, y FROM lk UNION SELECT y, x FROM lk),
  rc(n, r) AS (SELECT DISTINCT x, x FROM bi UNION SELECT bi.y, rc.r FROM rc JOIN bi ON bi.x = rc.n),
  cm AS (SELECT n, min(r) AS sequence_id FROM rc GROUP BY 1),
  me AS (SELECT e.*, sequence_id FROM few_events e JOIN cm ON cm.n = e.event_id)"""
_SEQ_COLS = ("sequence_id", "event_count", "start_time", "end_time", "duration_seconds", "severity")
add("build_sequences_all_rules", lambda s, d: C.describe_sequences(found_members(s, d, C.DEFAULT_RULES)).select(
    *_SEQ_COLS, "description"))

# --- the same scoring over plain groups ---------------------------------------------------------


def members(s, d):
    slot = F.floor(F.unix_seconds("ts") / 10_800)
    return events(s, d).withColumn("sequence_id", F.concat_ws("/", "source_ip", slot.cast("string"))).withColumn(
        "campaign_id", F.concat(F.lit("net"), F.split("source_ip", "\\.")[2], F.lit("-"), F.pmod(slot, F.lit(2)).cast("string")))


def sequences(s, d):
    return C.describe_sequences(members(s, d))


def campaigns(s, d):
    return members(s, d).select("sequence_id", "campaign_id").distinct()


def grouped(s, d):
    """Members with their sequence and campaign tables, each computed once."""
    mem = members(s, d)
    return mem, cut(C.describe_sequences(mem)), cut(mem.select("sequence_id", "campaign_id").distinct())


def _confidence(s, d):
    mem, seq, camp = grouped(s, d)
    return C.campaign_confidence(camp, seq, mem)


def _over_groups(s, d):
    mem, seq, camp = grouped(s, d)
    return C.build_campaigns(camp, seq, mem)


_MEM = """me AS (SELECT *, source_ip || '/' || CAST(epoch(ts)::BIGINT // 10800 AS VARCHAR) AS sequence_id,
    'net' || split_part(source_ip, '.', 3) || '-' || (epoch(ts)::BIGINT // 10800) % 2 AS campaign_id FROM corr_events),
  """
_SCORED = """fs AS (SELECT sequence_id, stage_idx, stage, min(ts) AS f FROM me GROUP BY 1, 2, 3),
  so AS (SELECT sequence_id, stage_idx, stage, f, lag(stage_idx) OVER (PARTITION BY sequence_id ORDER BY f) AS pv FROM fs),
  st AS (SELECT sequence_id, count(*) AS ns, count(*) FILTER (WHERE stage_idx >= pv) AS up,
     string_agg(upper(stage[1]) || replace(replace(replace(stage[2:], '_control', ' Control'), '_objectives', ' Objectives'), '_', ' '), ', ' ORDER BY f) AS names FROM so GROUP BY 1),
  pg AS (SELECT *, CASE WHEN ns = 1 THEN 0.5::DOUBLE ELSE least(0.7::DOUBLE * (up / (ns - 1)::DOUBLE) + 0.3::DOUBLE * (ns / 7.0::DOUBLE), 1.0) END AS prog FROM st),
  sg AS (SELECT m.sequence_id, any_value(campaign_id) AS campaign_id, count(*) AS n, min(ts) AS s, max(ts) AS e, epoch(max(ts))::BIGINT - epoch(min(ts))::BIGINT AS dur, max(confidence_score) AS conf,
     count(DISTINCT attack_type) AS nt, count(DISTINCT source_ip) AS n_src, count(DISTINCT destination_ip) AS n_dst,
     list_sort(list_distinct(list(attack_type))) AS types, any_value(prog) AS prog, any_value(ns) AS ns, any_value(names) AS names
     FROM me m JOIN pg ON pg.sequence_id = m.sequence_id GROUP BY 1),
  sc AS (SELECT *, least(n / 10.0::DOUBLE, 0.3) + least(dur / 3600.0::DOUBLE / 24, 0.2) + prog * 0.2::DOUBLE + conf * 0.15::DOUBLE + least(ns / 7.0::DOUBLE, 0.1) + least(nt / 5.0::DOUBLE, 0.05) AS score FROM sg),
  sv AS (SELECT *, CASE WHEN score >= 0.8::DOUBLE THEN 'critical' WHEN score >= 0.6::DOUBLE THEN 'high' WHEN score >= 0.4::DOUBLE THEN 'medium' ELSE 'low' END AS severity FROM sc)"""
_MEM += _SCORED
_FOUND_SCORED = f"{_FOUND}, " + _SCORED.replace("any_value(campaign_id) AS campaign_id, ", "")
add("build_sequences", lambda s, d: C.describe_sequences(found_members(s, d)).select(*_SEQ_COLS),
    duck("few_events", f"WITH RECURSIVE {_FOUND_SCORED} SELECT sequence_id, n AS event_count, s AS start_time, e AS end_time, dur AS duration_seconds, severity FROM sv"))
add("progression_score", lambda s, d: rounded(sequences(s, d).select("sequence_id", "progression_score")),
    duck("corr_events", f"WITH {_MEM} SELECT sequence_id, round(prog, 6) AS progression_score FROM sv"))
add("sequence_severity", lambda s, d: sequences(s, d).select("sequence_id", "event_count", "start_time", "end_time", "severity"),
    duck("corr_events", f"WITH {_MEM} SELECT sequence_id, n AS event_count, s AS start_time, e AS end_time, severity FROM sv"))
add("sequence_description", lambda s, d: sequences(s, d).select("sequence_id", "description"),
    duck("corr_events", f"""WITH {_MEM} SELECT sequence_id, 'Attack sequence with ' || n || ' events over ' || printf('%d:%02d:%02d', dur // 3600, (dur // 60) % 60, dur % 60)
      || ' involving ' || nt || ' attack types: ' || array_to_string(types[1:3], ', ') || CASE WHEN nt > 3 THEN ' and ' || (nt - 3) || ' others' ELSE '' END
      || '. Sources: ' || n_src || ' IPs, Targets: ' || n_dst || ' IPs. Kill chain stages: ' || names || '. Progression score: '
      || printf('%.2f', round(CAST(CAST(prog AS VARCHAR) AS DECIMAL(30,18)), 2)) || '.' AS description FROM sv"""))

_SETS = """se AS (SELECT sequence_id, min(ts) AS s, list_distinct(list(source_ip)) AS a, list_distinct(list(destination_ip)) AS b, list_distinct(list(attack_type)) AS c FROM me GROUP BY 1),
  pr AS (SELECT x.sequence_id AS a, y.sequence_id AS b,
     0.3::DOUBLE * len(list_intersect(x.a, y.a)) / len(list_distinct(x.a || y.a)) + 0.2::DOUBLE * len(list_intersect(x.b, y.b)) / len(list_distinct(x.b || y.b))
     + 0.3::DOUBLE * len(list_intersect(x.c, y.c)) / len(list_distinct(x.c || y.c)) + 0.2::DOUBLE * greatest(0, 1 - abs(epoch(x.s) - epoch(y.s)) / 86400) AS sim
     FROM se x JOIN se y ON x.sequence_id < y.sequence_id AND abs(epoch(x.s) - epoch(y.s)) <= 604800)"""
add("group_campaigns", lambda s, d: found_campaigns(s, d)[2],
    duck("few_events", f"""WITH RECURSIVE {_FOUND}, {_SETS}, sl AS (SELECT a AS x, b AS y FROM pr WHERE sim > 0.6::DOUBLE UNION SELECT b, a FROM pr WHERE sim > 0.6::DOUBLE),
      cr(n, r) AS (SELECT DISTINCT x, x FROM sl UNION SELECT sl.y, cr.r FROM cr JOIN sl ON sl.x = cr.n),
      cc AS (SELECT n AS sequence_id, min(r) AS campaign_id FROM cr GROUP BY 1)
      SELECT * FROM (SELECT sequence_id, campaign_id, count(*) OVER (PARTITION BY campaign_id) AS c FROM cc) WHERE c >= 3""").replace("SELECT * FROM (SELECT sequence_id, campaign_id", "SELECT sequence_id, campaign_id FROM (SELECT sequence_id, campaign_id"))


def _similar(s, d):
    m = members(s, d).select("sequence_id", "event_id", "ts", "source_ip", "destination_ip", "attack_type", "stage", "stage_idx", "confidence_score")
    m = s.read.schema(m.schema).parquet(kept_table(m, "members"))  # read by the descriptions and the values
    return rounded(C.sequence_similarity(C.describe_sequences(m), m))


add("sequence_similarity", _similar,
    duck("corr_events", f"WITH {_MEM}, {_SETS} SELECT a, b, round(sim, 6) AS similarity FROM pr WHERE sim > 0.6::DOUBLE"))

_CAMP_TAIL = """gp AS (SELECT *, epoch(s) - epoch(lag(e) OVER (PARTITION BY campaign_id ORDER BY s, sequence_id)) AS gap FROM sv),
  tc AS (SELECT campaign_id, CASE WHEN count(*) < 2 OR avg(gap) = 0 THEN 1.0 ELSE greatest(0, 1 - stddev_pop(gap) / avg(gap) / 2) END AS tcons FROM gp GROUP BY 1),
  ts_ AS (SELECT x.campaign_id, sum(len(list_intersect(p.b, q.b)) / len(list_distinct(p.b || q.b))::DOUBLE) AS j, count(*) AS c FROM sv x JOIN sv y ON x.campaign_id = y.campaign_id AND x.sequence_id < y.sequence_id
     JOIN se p ON p.sequence_id = x.sequence_id JOIN se q ON q.sequence_id = y.sequence_id GROUP BY 1),
  ct AS (SELECT campaign_id, list_sort(list_distinct(list(attack_type))) AS types, count(DISTINCT source_ip) AS n_src, count(DISTINCT destination_ip) AS n_dst FROM me GROUP BY 1),
  cf AS (SELECT campaign_id, count(*) AS sequence_count, min(s) AS start_time, arg_max(e, s::VARCHAR || sequence_id) AS end_time, sum(n)::BIGINT AS total_events, avg(prog) AS ap,
     max(CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) AS ms FROM sv GROUP BY 1),
  ca AS (SELECT cf.*, types, n_src, n_dst, tcons, coalesce(j / c, 0.0) AS dcons, least(least(sequence_count / 10.0::DOUBLE, 0.3) + ap * 0.25::DOUBLE + tcons * 0.2::DOUBLE + coalesce(j / c, 0.0) * 0.15::DOUBLE
     + least(len(types) / 5.0::DOUBLE, 1.0) * 0.1::DOUBLE, 1.0) AS conf FROM cf JOIN tc ON tc.campaign_id = cf.campaign_id JOIN ct ON ct.campaign_id = cf.campaign_id LEFT JOIN ts_ ON ts_.campaign_id = cf.campaign_id)"""
_CAMP = f"{_MEM}, {_SETS}, {_CAMP_TAIL}"
add("campaign_confidence",
    lambda s, d: rounded(_confidence(s, d).select(
        "campaign_id", "sequence_count", "total_events", "max_severity", "avg_progression_score", "time_consistency", "target_consistency", "confidence_score")),
    duck("corr_events", f"""WITH {_CAMP} SELECT campaign_id, sequence_count, total_events, (['low','medium','high','critical'])[ms + 1] AS max_severity, round(ap, 6) AS avg_progression_score,
      round(tcons, 6) AS time_consistency, round(dcons, 6) AS target_consistency, round(conf, 6) AS confidence_score FROM ca"""))


def _sets(s, d):
    """Campaign rows over hours, so type sets of several sizes occur."""
    m = members(s, d)
    return m.withColumn("campaign_id", F.concat_ws("/", "source_ip", F.date_format("ts", "HH"))).groupBy("campaign_id").agg(
        F.array_sort(F.collect_set("attack_type")).alias("types"), F.min("ts").alias("start"))


_HOURS = """ho AS (SELECT source_ip || '/' || strftime(ts, '%H') AS campaign_id, list_sort(list_distinct(list(attack_type))) AS types, min(ts) AS s FROM corr_events GROUP BY 1)"""
add("campaign_name", lambda s, d: _sets(s, d).select("campaign_id", C.campaign_name(F.col("types"), F.col("start")).alias("name")),
    duck("corr_events", f"""WITH {_HOURS} SELECT campaign_id, CASE WHEN len(types) = 1 THEN types[1] || ' Campaign' WHEN len(types) <= 3 THEN 'Multi-Vector Campaign (' || array_to_string(types, ', ') || ')'
      ELSE 'Complex Attack Campaign (' || len(types) || ' vectors)' END || ' - ' || strftime(s, '%Y%m%d') AS name FROM ho"""))
add("attribution", lambda s, d: _sets(s, d).select("campaign_id", C.attribution(F.col("types")).alias("attribution")),
    duck("corr_events", f"""WITH {_HOURS}, pa AS (SELECT campaign_id, list_transform(types, lambda x: replace(lower(x), ' ', '_')) AS p FROM ho),
      ac AS (SELECT * FROM (VALUES (0, 'APT1', ['probe','r2l','command_control']), (1, 'Lazarus', ['malware','ddos','u2r']), (2, 'FancyBear', ['probe','brute_force','lateral_movement'])) v(o, actor, known)),
      sc AS (SELECT campaign_id, actor, o, len(list_intersect(p, known)) / 3.0::DOUBLE AS score FROM pa, ac),
      be AS (SELECT campaign_id, actor, score, row_number() OVER (PARTITION BY campaign_id ORDER BY score DESC, o) AS r FROM sc WHERE score > 0.6)
      SELECT ho.campaign_id, actor || ' (confidence: ' || printf('%.2f', score) || ')' AS attribution FROM ho LEFT JOIN be ON be.campaign_id = ho.campaign_id AND r = 1"""))
_MITRE = """(VALUES ('Probe','TA0007','T1046'), ('Port Scan','TA0007','T1046'), ('Brute Force','TA0006','T1110'), ('DoS','TA0040','T1499'), ('DDoS','TA0040','T1498'),
  ('R2L','TA0008','T1021'), ('U2R','TA0004','T1068'), ('Malware','TA0002','T1204')) k(t, ta, te)"""


def _mitre(s, d):
    tactics, techniques = C.mitre_mapping(F.col("types"))
    return _sets(s, d).select("campaign_id", F.array_join(tactics, ",").alias("tactics"), F.array_join(techniques, ",").alias("techniques"))


add("mitre_mapping", _mitre,
    duck("corr_events", f"""WITH h AS (SELECT DISTINCT source_ip || '/' || strftime(ts, '%H') AS campaign_id, attack_type FROM corr_events)
      SELECT campaign_id, coalesce(string_agg(DISTINCT ta, ',' ORDER BY ta), '') AS tactics, coalesce(string_agg(DISTINCT te, ',' ORDER BY te), '') AS techniques
      FROM h LEFT JOIN {_MITRE} ON k.t = h.attack_type GROUP BY 1"""))
_IOC = "unnest(['ip:' || source_ip, 'port:' || source_port, 'protocol:' || protocol, 'attack_type:' || attack_type])"
add("campaign_iocs", lambda s, d: C.campaign_iocs(campaigns(s, d), members(s, d)),
    duck("corr_events", f"WITH {_MEM} SELECT DISTINCT campaign_id, {_IOC} AS indicator FROM me"))
_LINKED = f"""{_FOUND.replace("me AS (", "me0 AS (")}, {_SETS.replace("FROM me ", "FROM me0 ")},
  sl AS (SELECT a AS x, b AS y FROM pr WHERE sim > 0.6::DOUBLE UNION SELECT b, a FROM pr WHERE sim > 0.6::DOUBLE),
  cr(n, r) AS (SELECT DISTINCT x, x FROM sl UNION SELECT sl.y, cr.r FROM cr JOIN sl ON sl.x = cr.n),
  cc AS (SELECT n AS sequence_id, min(r) AS campaign_id FROM cr GROUP BY 1),
  cg AS (SELECT sequence_id, campaign_id FROM (SELECT *, count(*) OVER (PARTITION BY campaign_id) AS c FROM cc) WHERE c >= 3),
  me AS (SELECT me0.*, campaign_id FROM me0 JOIN cg ON cg.sequence_id = me0.sequence_id)"""
add("build_campaigns", lambda s, d: _built(s, d).select(
    "campaign_id", "sequence_count", "start_time", "end_time", "total_events", "max_severity", "source_count", "target_count", "indicator_count",
    F.array_join("attack_types", ",").alias("attack_types"), "time_consistency", "target_consistency", "confidence_score"),
    duck("few_events", f"""WITH RECURSIVE {_LINKED}, {_SCORED}, {_CAMP_TAIL}, io AS (SELECT campaign_id, count(DISTINCT i) AS n FROM (SELECT campaign_id, {_IOC} AS i FROM me) GROUP BY 1)
      SELECT ca.campaign_id, sequence_count, start_time, end_time, total_events, (['low','medium','high','critical'])[ms + 1] AS max_severity, n_src AS source_count, n_dst AS target_count,
        io.n AS indicator_count, array_to_string(types, ',') AS attack_types, round(tcons, 6) AS time_consistency, round(dcons, 6) AS target_consistency, round(conf, 6) AS confidence_score
      FROM ca JOIN io ON io.campaign_id = ca.campaign_id"""))
add("campaigns_over_groups",
    lambda s, d: rounded(_over_groups(s, d).select(
        "campaign_id", "name", "start_time", "end_time", "duration_seconds", "source_count", "target_count", "indicator_count",
        F.array_join("attack_types", ",").alias("attack_types"), "confidence_score")),
    duck("corr_events", f"""WITH {_CAMP}, io AS (SELECT campaign_id, count(DISTINCT i) AS n FROM (SELECT campaign_id, {_IOC} AS i FROM me) GROUP BY 1)
      SELECT ca.campaign_id, 'Complex Attack Campaign (' || len(types) || ' vectors) - ' || strftime(start_time, '%Y%m%d') AS name, start_time, end_time,
        epoch(end_time)::BIGINT - epoch(start_time)::BIGINT AS duration_seconds, n_src AS source_count, n_dst AS target_count, io.n AS indicator_count,
        array_to_string(types, ',') AS attack_types, round(conf, 6) AS confidence_score FROM ca JOIN io ON io.campaign_id = ca.campaign_id"""))

_CTX = """cx AS (SELECT e.source_ip, arg_min(attack_type, ts) AS threat_type, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(confidence_score, ts) AS lc FROM corr_events e GROUP BY 1),
  iv AS (SELECT split_part(sequence_id, '/', 1) AS source_ip, count(*) AS n, max(CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) AS ms FROM sv GROUP BY 1),
  tx AS (SELECT cx.*, ms, least(lc + least(n * 0.1::DOUBLE, 0.3), 1.0) AS confidence FROM cx JOIN iv ON iv.source_ip = cx.source_ip)"""


def context(s, d):
    return C.threat_context(events(s, d), sequences(s, d), members(s, d))


add("threat_context", lambda s, d: rounded(context(s, d)),
    duck("corr_events", f"""WITH {_MEM}, {_CTX} SELECT 'threat_' || md5(source_ip)[:8] AS threat_id, source_ip, threat_type, (['low','medium','high','critical'])[ms + 1] AS severity,
      round(confidence, 6) AS confidence, first_seen, last_seen FROM tx"""))


def _prioritized(s, d):
    mem, seq, camp = grouped(s, d)
    return C.prioritize_alerts(alerts(s, d), C.threat_context(events(s, d), seq, mem), seq, mem, camp, C.campaign_confidence(camp, seq, mem), NOW, recent_campaigns=3)


add("prioritize_alerts", lambda s, d: rounded(_prioritized(s, d).select("record_id", "priority_score")),
    duck("corr_events", f"""WITH {_CAMP}, {_CTX}, ls AS (SELECT split_part(sequence_id, '/', 1) AS source_ip, arg_max(prog, s) AS p FROM sv WHERE s >= TIMESTAMP '2023-12-31 11:10:00' GROUP BY 1),
      lc AS (SELECT campaign_id, start_time, conf FROM ca ORDER BY start_time DESC, campaign_id DESC LIMIT 3),
      cs AS (SELECT source_ip, arg_max(lc.conf, lc.start_time::VARCHAR || lc.campaign_id) AS c FROM me JOIN lc ON lc.campaign_id = me.campaign_id GROUP BY 1)
      SELECT event_id AS record_id, round(least(confidence_score * 0.25::DOUBLE + CASE e.severity WHEN 'LOW' THEN 0.2 WHEN 'MEDIUM' THEN 0.5 WHEN 'HIGH' THEN 0.8 ELSE 1.0 END::DOUBLE * 0.2::DOUBLE
        + tx.confidence * 0.2::DOUBLE + coalesce(ls.p, 0) * 0.15::DOUBLE + coalesce(cs.c, 0) * 0.15::DOUBLE
        + greatest(0.1, 1 - epoch(TIMESTAMP '2024-01-01 11:10:00') / 3600 + epoch(ts) / 3600) * 0.05::DOUBLE, 1.0), 6) AS priority_score
      FROM corr_events e JOIN tx ON tx.source_ip = e.source_ip LEFT JOIN ls ON ls.source_ip = e.source_ip LEFT JOIN cs ON cs.source_ip = e.source_ip"""))
add("correlation_stats",
    lambda s, d: C.correlation_stats(events(s, d), sequences(s, d), C.campaign_facts(campaigns(s, d), sequences(s, d)), datetime(2024, 1, 2, 4)),
    duck("corr_events", f"""WITH {_CAMP} SELECT 'total_events' AS item, count(*) AS n FROM corr_events UNION ALL SELECT 'recent_events_24h', count(*) FROM corr_events WHERE ts >= TIMESTAMP '2024-01-01 04:00:00'
      UNION ALL SELECT 'total_sequences', count(*) FROM sv UNION ALL SELECT 'recent_sequences_24h', count(*) FROM sv WHERE s >= TIMESTAMP '2024-01-01 04:00:00'
      UNION ALL SELECT 'total_campaigns', count(*) FROM ca UNION ALL SELECT 'recent_campaigns_24h', count(*) FROM ca WHERE start_time >= TIMESTAMP '2024-01-01 04:00:00'
      UNION ALL SELECT 'active_rules', 4"""))
add("recent_sequences", lambda s, d: C.newest(sequences(s, d), "sequence_id", 20).select("sequence_id", "start_time"),
    duck("corr_events", f"WITH {_MEM} SELECT sequence_id, s AS start_time FROM sv ORDER BY s DESC, sequence_id DESC LIMIT 20"))
add("recent_campaigns", lambda s, d: C.newest(C.campaign_facts(campaigns(s, d), sequences(s, d)), "campaign_id", 5).select("campaign_id", "start_time"),
    duck("corr_events", f"WITH {_CAMP} SELECT campaign_id, start_time FROM ca ORDER BY start_time DESC, campaign_id DESC LIMIT 5"))

QUERIES, ORACLE = book.queries, book.oracle
