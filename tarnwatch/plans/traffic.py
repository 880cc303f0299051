"""Queries on traffic records: per-record features, flows, the 29-feature vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions import net, text
from tarnwatch.operators import features as X
from tarnwatch.operators import flows as W
from tarnwatch.plans.support import Book, rounded
from tarnwatch.plans.views import duck, table, traffic

book = Book()
add = book.add
PAIR = ("source_ip", "destination_ip")

add("basic_features",
    lambda s, d: X.basic_features(traffic(s, d)).select("record_id", "packet_size", "duration", "protocol_encoded"),
    duck("traffic", """SELECT record_id, CAST(packet_size AS DOUBLE) AS packet_size, duration,
      CASE upper(protocol) WHEN 'TCP' THEN 1.0::DOUBLE WHEN 'UDP' THEN 2.0 WHEN 'ICMP' THEN 3.0 ELSE 0.0 END AS protocol_encoded
      FROM traffic"""))

add("flag_features",
    lambda s, d: X.flag_features(traffic(s, d)).select("record_id", *[f"flag_{f}" for f in K.FLOW_FLAGS]),
    duck("traffic", "SELECT record_id, " + ", ".join(
        f"CAST(list_contains(string_split(lower(flags_csv), ','), '{f}') AS DOUBLE) AS flag_{f}"
        for f in K.FLOW_FLAGS) + " FROM traffic"))

_PORT_SQL = "CASE WHEN {p} < 1024 THEN 1.0::DOUBLE WHEN {p} < 49152 THEN 2.0 ELSE 3.0 END"
add("port_category",
    lambda s, d: X.port_features(traffic(s, d)).select("record_id", "src_port_category", "dst_port_category"),
    duck("traffic", f"""SELECT record_id, {_PORT_SQL.format(p='source_port')} AS src_port_category,
      {_PORT_SQL.format(p='destination_port')} AS dst_port_category FROM traffic"""))

add("time_features",
    lambda s, d: X.time_features(traffic(s, d)).select("record_id", "hour_of_day", "day_of_week"),
    duck("traffic", """SELECT record_id, CAST(hour(ts) AS DOUBLE) AS hour_of_day,
      CAST(isodow(ts) - 1 AS DOUBLE) AS day_of_week FROM traffic"""))

add("decode_tcp_flags",
    lambda s, d: X.tcp_flags(traffic(s, d).withColumn("flag_bits", (F.col("k") * 5) % 256)).select(
        "record_id", F.array_join("tcp_flags", ",").alias("tcp_flags")),
    duck("traffic", """SELECT record_id, concat_ws(',', """ + ", ".join(
        f"CASE WHEN ((k * 5) % 256) & {1 << i} <> 0 THEN '{f}' END" for i, f in enumerate(K.TCP_FLAG_BITS))
        + ") AS tcp_flags FROM traffic"))

add("length_features",
    lambda s, d: X.length_features(traffic(s, d).withColumn(
        "ihl", F.when(F.col("k") % 4 != 0, 5 + F.col("k") % 10))).select(
        "record_id", "header_length", "payload_length"),
    duck("traffic", """SELECT record_id, CAST(h AS INT) AS header_length, CAST(packet_size - h AS INT) AS payload_length
      FROM (SELECT *, CASE WHEN k % 4 <> 0 THEN (5 + k % 10) * 4 ELSE 40 END AS h FROM traffic)"""))

_PROTO_NUM = "CASE upper(protocol) WHEN 'TCP' THEN 6 WHEN 'UDP' THEN 17 WHEN 'ICMP' THEN 1 ELSE 0 END"
add("behavior_features",
    lambda s, d: rounded(X.behavior_features(
        traffic(s, d).withColumn("features", F.create_map(
            F.lit("duration"), F.col("k") * 1.0, F.lit("k_value"), F.col("k") * 2.0)))
        .select("record_id", F.explode("behavior").alias("feature", "value"))),
    duck("traffic", f"""SELECT record_id, unnest(['packet_size','destination_port','source_port','protocol_numeric',
        'hour_of_day','day_of_week','flags_count','duration','k_value']) AS feature,
      unnest([CAST(packet_size AS DOUBLE), destination_port, source_port, {_PROTO_NUM}, hour(ts), isodow(ts) - 1,
        len(string_split(flags_csv, ',')), k * 1.0, k * 2.0]) AS value FROM traffic"""))

add("filter_traffic",
    lambda s, d: X.filter_traffic(traffic(s, d), ("tcp", "udp"), False, "destination_port IN (80, 443)").select(
        "record_id", "protocol", "destination_port"),
    duck("traffic", """SELECT record_id, protocol, destination_port FROM traffic
      WHERE protocol IN ('TCP','UDP') AND destination_port IN (80, 443)"""))

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_HOST = "concat_ws('.', replace(lower(lang), '_', '-'), source, CAST(doc_id % 300 AS STRING))"
_ADDR = "concat_ws('.', CAST(doc_id % 300 AS STRING), CAST(doc_id % 7 AS STRING), '0', CAST(n_chars % 256 AS STRING))"
add("address_validity",
    lambda s, d: table(s, d, "documents").select(
        "doc_id", net.is_valid_ip(F.expr(_ADDR), ipv6=False).alias("valid_ip"),
        net.is_valid_domain(F.expr(_HOST)).alias("valid_domain")),
    f"""SELECT doc_id, regexp_full_match({_ADDR}, '{_OCTET}\\.{_OCTET}\\.{_OCTET}\\.{_OCTET}') AS valid_ip,
      regexp_full_match({_HOST}, '([a-zA-Z0-9]([a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?\\.)*[a-zA-Z0-9]([a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?')
        AND length({_HOST}) <= 253 AS valid_domain FROM documents""")

_LONG = ("(CAST(split_part({ip}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({ip}, '.', 2) AS BIGINT) * 65536"
         " + CAST(split_part({ip}, '.', 3) AS BIGINT) * 256 + CAST(split_part({ip}, '.', 4) AS BIGINT))")
add("ip_in_cidr",
    lambda s, d: traffic(s, d).select(
        "record_id", net.ip_in_network("source_ip", "192.168.1.77/25").alias("in_block"),
        net.ip_in_network("destination_ip", "10.0.0.3").alias("is_host"),
        net.ip_in_cidr("source_ip", F.concat(F.lit("192.168.2."), F.col("k"), F.lit("/27"))).alias("in_row_block")),
    duck("traffic", f"""SELECT record_id, {_LONG.format(ip='source_ip')} // 128 = (3232235776 // 128) AS in_block,
      destination_ip = '10.0.0.3' AS is_host,
      {_LONG.format(ip='source_ip')} // 32 = (3232236032 + k) // 32 AS in_row_block FROM traffic"""))

add("flow_key",
    lambda s, d: traffic(s, d).select("record_id", net.flow_key().alias("flow_key")),
    duck("traffic", """SELECT record_id, least(source_ip, destination_ip) || ':' || least(source_port, destination_port)
      || '-' || greatest(source_ip, destination_ip) || ':' || greatest(source_port, destination_port) || '-' || protocol
      AS flow_key FROM traffic"""))

add("confidence_bins", lambda s, d: X.confidence_counts(traffic(s, d).withColumn(
        "confidence_score", F.when(F.col("confidence_score") >= 0.8, 0.95).otherwise(F.col("confidence_score")))),  # leaves a bin empty
    duck("traffic", """SELECT b.bin, count(t.record_id) AS n FROM (VALUES ('0.9-1.0', 0.9, 9.0), ('0.8-0.9', 0.8, 0.9),
      ('0.7-0.8', 0.7, 0.8), ('0.6-0.7', 0.6, 0.7), ('0.5-0.6', 0.5, 0.6), ('0.0-0.5', -1.0, 0.5)) b(bin, lo, hi)
      LEFT JOIN (SELECT record_id, CASE WHEN confidence_score >= 0.8::DOUBLE THEN 0.95::DOUBLE ELSE confidence_score END AS confidence_score FROM traffic) t
        ON t.confidence_score >= b.lo::DOUBLE AND t.confidence_score < b.hi::DOUBLE GROUP BY b.bin"""))

add("md5_ids",
    lambda s, d: traffic(s, d).select(
        "record_id", text.md5_id(["source_ip", "destination_ip", "record_id"], 16).alias("alert_key"),
        F.concat(F.lit("threat_"), text.md5_id(["source_ip"], 8)).alias("threat_id")),
    duck("traffic", """SELECT record_id, md5(source_ip || ':' || destination_ip || ':' || record_id)[:16] AS alert_key,
      'threat_' || md5(source_ip)[:8] AS threat_id FROM traffic"""))

add("redact_log_messages",
    lambda s, d: table(s, d, "documents").select("doc_id", F.md5(text.redact("text")).alias("message_md5"),
                                                 (text.redact("text") == K.REDACTED).alias("redacted")),
    """SELECT doc_id, md5(CASE WHEN r THEN '[REDACTED - Sensitive information removed]' ELSE text END) AS message_md5,
      r AS redacted FROM (SELECT *, contains(lower(text), 'password') OR contains(lower(text), 'token')
        OR contains(lower(text), 'key') OR contains(lower(text), 'secret') OR contains(lower(text), 'auth')
        OR contains(lower(text), 'credential') AS r FROM documents)""")

add("sanitize_text",
    lambda s, d: table(s, d, "pages").select("page_id", text.sanitize_or_reject("html", 2000).alias("t")).select(
        "page_id", F.md5("t.clean").alias("clean_md5"), F.length("t.clean").alias("n"), "t.rejected"),
    """SELECT page_id, md5(c) AS clean_md5, CAST(length(c) AS INT) AS n, rejected FROM (
      SELECT page_id, length(html) > 2000 AS rejected, CASE WHEN length(html) <= 2000 THEN trim(translate(html, '<>"''&' || chr(0), '')) END AS c FROM pages)""")

# --- flows ---------------------------------------------------------------------

_SESSIONS = """pk AS (SELECT *, concat_ws('|', source_ip, destination_ip) AS fk FROM traffic),
gaps AS (SELECT *, lag(ts) OVER (PARTITION BY fk ORDER BY ts, record_id) AS prev FROM pk),
sess AS (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > 300000000 THEN 1 ELSE 0 END)
           OVER (PARTITION BY fk ORDER BY ts, record_id) AS sid FROM gaps)"""

add("flows",
    lambda s, d: rounded(W.flows(traffic(s, d), flow_cols=PAIR)).withColumn("flags", F.array_join("flags", ",")),
    duck("traffic", f"""WITH {_SESSIONS},
    fl AS (SELECT fk, sid, array_to_string(list_sort(list_distinct(flatten(list(string_split(flags_csv, ','))))), ',') AS flags
           FROM sess GROUP BY 1, 2)
    SELECT s.fk AS flow_key, count(*) AS packet_count, CAST(sum(packet_size) AS BIGINT) AS total_bytes, min(ts) AS start_time,
      max(ts) AS last_time, any_value(f.flags) AS flags,
      round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS duration
    FROM sess s JOIN fl f ON s.fk = f.fk AND s.sid = f.sid GROUP BY s.fk, s.sid"""))

# the same over all five fields, both directions of a conversation together
_FIVE = _SESSIONS.replace("concat_ws('|', source_ip, destination_ip) AS fk", """least(source_ip, destination_ip) || ':' || least(source_port, destination_port)
  || '-' || greatest(source_ip, destination_ip) || ':' || greatest(source_port, destination_port) || '-' || protocol AS fk""")


def _bidirectional(s, d):
    """Traffic of few ports, whose every third packet is an answer."""
    t = traffic(s, d).withColumns({"source_port": F.lit(1024) + (F.col("record_id") % 2).cast("int"), "destination_port": F.lit(443)})
    back = F.col("record_id") % 3 == 0
    turn = lambda a, b: F.when(back, F.col(b)).otherwise(F.col(a))
    return t.withColumns({"source_ip": turn("source_ip", "destination_ip"), "destination_ip": turn("destination_ip", "source_ip"),
                          "source_port": turn("source_port", "destination_port"), "destination_port": turn("destination_port", "source_port")})


_BIDIRECTIONAL = """few AS (SELECT * REPLACE (CAST(1024 + record_id % 2 AS INT) AS source_port, 443 AS destination_port) FROM traffic),
turned AS (SELECT * REPLACE (CASE WHEN record_id % 3 = 0 THEN destination_ip ELSE source_ip END AS source_ip,
  CASE WHEN record_id % 3 = 0 THEN source_ip ELSE destination_ip END AS destination_ip,
  CASE WHEN record_id % 3 = 0 THEN destination_port ELSE source_port END AS source_port,
  CASE WHEN record_id % 3 = 0 THEN source_port ELSE destination_port END AS destination_port) FROM few), """
_FIVE_BOTH = _BIDIRECTIONAL + _FIVE.replace("FROM traffic", "FROM turned")

add("flows_five_fields",
    lambda s, d: rounded(W.flows(_bidirectional(s, d), timeout=3600)).withColumn("flags", F.array_join("flags", ",")),
    duck("traffic", f"""WITH {_FIVE_BOTH.replace('300000000', '3600000000')},
    fl AS (SELECT fk, sid, array_to_string(list_sort(list_distinct(flatten(list(string_split(flags_csv, ','))))), ',') AS flags
           FROM sess GROUP BY 1, 2)
    SELECT s.fk AS flow_key, count(*) AS packet_count, CAST(sum(packet_size) AS BIGINT) AS total_bytes, min(ts) AS start_time,
      max(ts) AS last_time, any_value(f.flags) AS flags,
      round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS duration
    FROM sess s JOIN fl f ON s.fk = f.fk AND s.sid = f.sid GROUP BY s.fk, s.sid"""))

_RUN = """, run AS (SELECT *,
   (epoch_us(ts) - epoch_us(first_value(ts) OVER w)) / 1e6 AS flow_duration,
   CAST(count(*) OVER w AS DOUBLE) AS flow_packet_count, CAST(sum(packet_size) OVER w AS DOUBLE) AS flow_bytes_total
   FROM sess WINDOW w AS (PARTITION BY fk, sid ORDER BY ts, record_id ROWS UNBOUNDED PRECEDING)),
 stat AS (SELECT *, CASE WHEN count(*) OVER u > 1 THEN (epoch_us(ts) - epoch_us(prev)) / 1e6 END AS ia FROM run
   WINDOW u AS (PARTITION BY fk, sid ORDER BY ts, record_id ROWS UNBOUNDED PRECEDING))"""
_RUN_COLS = """round(flow_duration, 6) AS flow_duration, flow_packet_count, flow_bytes_total,
  round(flow_bytes_total / greatest(flow_duration, 0.001), 6) AS flow_bytes_per_second,
  round(flow_packet_count / greatest(flow_duration, 0.001), 6) AS flow_packets_per_second"""
add("running_flow_features",
    lambda s, d: rounded(W.running_flow_features(traffic(s, d), flow_cols=PAIR).select(
        "record_id", *K.FEATURE_NAMES[3:8])),
    duck("traffic", f"WITH {_SESSIONS}{_RUN} SELECT record_id, {_RUN_COLS} FROM run"))
add("running_flow_features_five_fields",
    # rates of whole seconds lie on rounding borders: both engines round a little above them
    lambda s, d: rounded(W.running_flow_features(_bidirectional(s, d), timeout=3600).select("record_id", *K.FEATURE_NAMES[3:8]).withColumns(
        {c: F.col(c) + 1e-9 for c in ("flow_bytes_per_second", "flow_packets_per_second")})),
    duck("traffic", f"WITH {_FIVE_BOTH.replace('300000000', '3600000000')}{_RUN} SELECT record_id, {_RUN_COLS.replace('0.001), 6)', '0.001) + 1e-9, 6)')} FROM run"))

_STAT_COLS = ", ".join(
    f"round(CAST(coalesce({fn}({src}) OVER r, 0) AS DOUBLE), 6) AS {name}_{label}"
    for name, src in (("packet_size", "packet_size"), ("inter_arrival", "ia"))
    for label, fn in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))
add("recent_flow_stats",
    lambda s, d: rounded(W.recent_flow_stats(traffic(s, d), n=3, flow_cols=PAIR).select(
        "record_id", *K.FEATURE_NAMES[8:16])),
    duck("traffic", f"""WITH {_SESSIONS}{_RUN} SELECT record_id, {_STAT_COLS} FROM stat
      WINDOW r AS (PARTITION BY fk, sid ORDER BY ts, record_id ROWS 2 PRECEDING)"""))
add("recent_flow_stats_five_fields",
    lambda s, d: rounded(W.recent_flow_stats(_bidirectional(s, d), n=3, timeout=3600).select("record_id", *K.FEATURE_NAMES[8:16])),
    duck("traffic", f"""WITH {_FIVE_BOTH.replace('300000000', '3600000000')}{_RUN} SELECT record_id, {_STAT_COLS} FROM stat
      WINDOW r AS (PARTITION BY fk, sid ORDER BY ts, record_id ROWS 2 PRECEDING)"""))

_FREQ = """, ports AS (SELECT record_id, ts, source_port AS port FROM traffic
      UNION ALL SELECT record_id, ts, destination_port FROM traffic),
  pc AS (SELECT DISTINCT record_id, port, count(*) OVER (PARTITION BY port ORDER BY ts, record_id) AS c FROM ports),
  gl AS (SELECT record_id, source_port, destination_port,
      count(*) OVER (PARTITION BY protocol ORDER BY ts, record_id) AS cp,
      least(row_number() OVER (ORDER BY ts, record_id), 100) AS n FROM traffic),
  freq AS (SELECT g.record_id, cp / n::DOUBLE AS protocol_frequency, a.c / n::DOUBLE AS port_frequency_src,
      b.c / n::DOUBLE AS port_frequency_dst FROM gl g
      JOIN pc a ON a.record_id = g.record_id AND a.port = g.source_port
      JOIN pc b ON b.record_id = g.record_id AND b.port = g.destination_port)"""
add("global_frequency_features",
    lambda s, d: rounded(W.global_frequency_features(traffic(s, d))),
    duck("traffic", f"""WITH {_SESSIONS}{_FREQ} SELECT record_id, round(protocol_frequency, 6) AS protocol_frequency,
      round(port_frequency_src, 6) AS port_frequency_src, round(port_frequency_dst, 6) AS port_frequency_dst FROM freq"""))

add("traffic_features",
    lambda s, d: rounded(W.traffic_features(traffic(s, d), flow_cols=PAIR)),
    duck("traffic", f"""WITH {_SESSIONS}{_RUN}{_FREQ}
    SELECT s.record_id, CAST(packet_size AS DOUBLE) AS packet_size, round(duration, 6) AS duration,
      CASE protocol WHEN 'TCP' THEN 1.0::DOUBLE WHEN 'UDP' THEN 2.0 WHEN 'ICMP' THEN 3.0 ELSE 0.0 END AS protocol_encoded,
      {_RUN_COLS}, {_STAT_COLS},
      {", ".join(f"CAST(list_contains(string_split(lower(flags_csv), ','), '{f}') AS DOUBLE) AS flag_{f}" for f in K.FLOW_FLAGS)},
      {_PORT_SQL.format(p='s.source_port')} AS src_port_category, {_PORT_SQL.format(p='s.destination_port')} AS dst_port_category,
      CAST(hour(ts) AS DOUBLE) AS hour_of_day, CAST(isodow(ts) - 1 AS DOUBLE) AS day_of_week,
      round(protocol_frequency, 6) AS protocol_frequency, round(port_frequency_src, 6) AS port_frequency_src,
      round(port_frequency_dst, 6) AS port_frequency_dst
    FROM stat s JOIN freq f ON f.record_id = s.record_id
    WINDOW r AS (PARTITION BY fk, sid ORDER BY ts, s.record_id ROWS 99 PRECEDING)"""))

add("flow_summary",
    lambda s, d: W.flow_summary(traffic(s, d), flow_cols=PAIR),
    duck("traffic", """WITH fl AS (SELECT source_ip, destination_ip, max(ts) AS last FROM traffic GROUP BY 1, 2),
      ports AS (SELECT source_port AS port FROM traffic UNION ALL SELECT destination_port FROM traffic)
    SELECT 'flows' AS section, 'active' AS item, count(*) AS n FROM fl
      WHERE epoch_us((SELECT max(ts) FROM traffic)) - epoch_us(last) <= 300000000
    UNION ALL SELECT 'protocol', protocol, count(*) FROM traffic GROUP BY protocol
    UNION ALL (SELECT 'port', CAST(port AS STRING), count(*) AS n FROM ports GROUP BY port ORDER BY n DESC, port LIMIT 10)"""))

_SCALING = {"packet_size": (1000.0, 250.0), "duration": (1.0, 2.0)}
add("align_features",
    lambda s, d: rounded(W.align_features(X.port_features(X.basic_features(traffic(s, d))), scaling=_SCALING)),
    duck("traffic", "SELECT record_id, " + ", ".join(
        {"packet_size": "round((packet_size - 1000.0::DOUBLE) / 250, 6)", "duration": "round((duration - 1.0) / 2.0, 6)",
         "protocol_encoded": "CASE protocol WHEN 'TCP' THEN 1.0::DOUBLE WHEN 'UDP' THEN 2.0 WHEN 'ICMP' THEN 3.0 ELSE 0.0 END",
         "src_port_category": _PORT_SQL.format(p="source_port"),
         "dst_port_category": _PORT_SQL.format(p="destination_port")}.get(n, "0.0::DOUBLE") + f" AS {n}"
        for n in K.FEATURE_NAMES) + " FROM traffic"))

QUERIES, ORACLE = book.queries, book.oracle
