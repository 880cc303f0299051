"""The test tables seen as security data: Spark DataFrames and the same views as DuckDB SQL.

``events`` rows play packets/predictions on a compressed clock (4 s per event);
``traffic_slow`` keeps the original clock. Both engines see identical rows.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwatch.operators import alerts as A
from tarnwatch.session import prepare

EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _traffic(spark: SparkSession, sf_dir: str, slow: bool) -> DataFrame:
    return traffic_of(table(spark, sf_dir, "events"), slow)


def traffic_stream(spark: SparkSession, sf_dir: str, slow: bool = False) -> DataFrame:
    """The same view over ``events`` read as a file stream."""
    schema = table(spark, sf_dir, "events").schema
    return traffic_of(spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet"), slow)


def traffic_of(ev: DataFrame, slow: bool = False) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    ts = F.col("ts").cast("timestamp") if slow else F.timestamp_seconds(
        F.lit(EPOCH) + F.col("event_id") * 4)
    attack = F.expr("""
        CASE event_type
          WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'Probe' ELSE 'Port Scan' END
          WHEN 'signup' THEN CASE k % 3 WHEN 0 THEN 'Brute Force' WHEN 1 THEN 'R2L' ELSE 'U2R' END
          WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'Malware' ELSE 'Command Control' END
          WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 'DoS' ELSE 'DDoS' END END""")
    return (ev.withColumn("k", k).select(
        F.col("event_id").alias("record_id"), ts.alias("ts"),
        F.expr("concat('192.168.', user_id % 4, '.', user_id % 50)").alias("source_ip"),
        F.expr("concat('10.0.0.', event_id % 8)").alias("destination_ip"),
        F.expr("CAST(1024 + (event_id * 7919) % 64512 AS INT)").alias("source_port"),
        F.expr("CAST(element_at(array(80, 443, 22, 21, 25, 53), CAST(event_id % 6 AS INT) + 1) AS INT)")
        .alias("destination_port"),
        F.expr("element_at(array('TCP', 'UDP', 'ICMP', 'TCP', 'UDP'), CAST(event_id % 5 AS INT) + 1)")
        .alias("protocol"),
        F.expr("CAST(40 + floor(value * 30) AS INT)").alias("packet_size"),
        (F.col("value") / 100).alias("duration"),
        F.expr("""CASE event_type WHEN 'signup' THEN 'SYN' WHEN 'click' THEN 'SYN,ACK'
                  WHEN 'view' THEN 'ACK' WHEN 'purchase' THEN 'PSH,ACK' ELSE 'RST' END""")
        .alias("flags_csv"),
        "k", attack.isNotNull().alias("is_malicious"), attack.alias("attack_type"),
        (F.expr("CAST(50 + k % 51 AS DOUBLE)") / 100).alias("confidence_score"),
        F.when(F.col("event_id") % 3 == 0, "rf-1.0.0").otherwise("rf-1.1.0").alias("model_version"),
    ).withColumn("flags", F.split("flags_csv", ","))
     .withColumn("features", F.create_map(
         F.lit("bytes_per_second"), F.try_divide(F.col("packet_size"), F.col("duration")),
         F.lit("k_value"), F.col("k").cast("double"))))


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traffic(spark, sf_dir, slow=False)


def traffic_slow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traffic(spark, sf_dir, slow=True)


def _predictions(t: DataFrame) -> DataFrame:
    return t.select("record_id", "ts", "is_malicious", "attack_type", "confidence_score",
                    "model_version", (F.col("k") + 5).alias("processing_time_ms"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(traffic(spark, sf_dir))


def predictions_slow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(traffic_slow(spark, sf_dir))


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traffic_slow(spark, sf_dir)
    return t.select("record_id", "ts", "is_malicious", "attack_type", "confidence_score",
                    "model_version",
                    (F.col("is_malicious") != (F.col("k") % 10 == 0)).alias("actual_label"),
                    (F.col("k") + 20).alias("response_time_ms"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert rows as A1 + A2 produce them, keyed by the record that raised them."""
    return A.alert_rows(traffic(spark, sf_dir))


def alerts_slow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.alert_rows(traffic_slow(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts as correlated events (kill-chain stage attached)."""
    from tarnwatch.operators import correlate as C
    return C.with_stage(alerts(spark, sf_dir).withColumnRenamed("record_id", "event_id"))


def moment(df: DataFrame, part: int, of: int):
    """The whole second at part / of the time that the rows span, as UTC without zone."""
    lo, hi = df.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    return datetime.fromtimestamp(lo + (hi - lo) * part // of, UTC).replace(tzinfo=None)


def duck_moment(view: str, part: int, of: int) -> str:
    return (f"(SELECT make_timestamp((lo + (hi - lo) * {part} // {of}) * 1000000) FROM (SELECT min(epoch_us(ts)) // 1000000 AS lo, "
            f"max(epoch_us(ts)) // 1000000 AS hi FROM {view}))")


def few_sources(events: DataFrame) -> DataFrame:
    """Events of a small table from fewer sources (one for 200 of them and subnet), so that each still has sequences."""
    hosts = max(events.count() // 200, 1)
    octets = F.split("source_ip", "\\.")
    return events.withColumn("source_ip", F.concat(F.lit("192.168."), octets[2], F.lit("."), (octets[3].cast("int") % hosts).cast("string")))


def geo_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five IPv4 blocks located in the first five nations."""
    blocks = F.array(*[
        F.struct(F.lit(i).alias("n"), F.lit(start).cast("long").alias("range_start"),
                 F.lit(start + 255).cast("long").alias("range_end"))
        for i, start in enumerate([3232235520 + 256 * j for j in range(4)] + [167772160])])
    nation = table(spark, sf_dir, "nation").where("n_nationkey < 5")
    return (nation.withColumn("b", F.explode(blocks)).where("b.n = n_nationkey")
            .select("b.range_start", "b.range_end", F.col("n_name").alias("country")))


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    octet = F.element_at(F.split("source_ip", "\\."), -1).cast("int")
    ips = traffic(spark, sf_dir).select("source_ip").distinct().withColumn("octet", octet)

    def feed(modulus: int, source: str, threat: str) -> DataFrame:
        return ips.where(F.col("octet") % modulus == 0).select(
            F.col("source_ip").alias("indicator"), F.lit("ip").alias("indicator_type"),
            F.lit(threat).alias("threat_type"), F.lit(0.8).alias("confidence"),
            F.lit(source).alias("source"))

    return feed(7, "abuse_ch", "botnet").unionByName(feed(14, "tor_exit_nodes", "tor"))


# --- the same views for DuckDB ----------------------------------------------

def _duck_traffic(ts: str) -> str:
    return f"""SELECT record_id, ts, source_ip, destination_ip, source_port, destination_port, protocol,
       packet_size, duration, flags_csv, k, attack_type IS NOT NULL AS is_malicious,
       attack_type, confidence_score, model_version
FROM (
  SELECT event_id AS record_id, {ts} AS ts,
    concat('192.168.', CAST(user_id % 4 AS STRING), '.', CAST(user_id % 50 AS STRING)) AS source_ip,
    concat('10.0.0.', CAST(event_id % 8 AS STRING)) AS destination_ip,
    CAST(1024 + (event_id * 7919) % 64512 AS INT) AS source_port,
    CAST(CASE event_id % 6 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 22
                           WHEN 3 THEN 21 WHEN 4 THEN 25 ELSE 53 END AS INT) AS destination_port,
    CASE event_id % 5 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' WHEN 2 THEN 'ICMP'
                      WHEN 3 THEN 'TCP' ELSE 'UDP' END AS protocol,
    CAST(40 + floor(value * 30) AS INT) AS packet_size,
    value / 100 AS duration,
    CASE event_type WHEN 'signup' THEN 'SYN' WHEN 'click' THEN 'SYN,ACK' WHEN 'view' THEN 'ACK'
                    WHEN 'purchase' THEN 'PSH,ACK' ELSE 'RST' END AS flags_csv,
    k,
    CASE WHEN event_type = 'click' THEN CASE WHEN k % 2 = 0 THEN 'Probe' ELSE 'Port Scan' END
         WHEN event_type = 'signup' THEN CASE k % 3 WHEN 0 THEN 'Brute Force' WHEN 1 THEN 'R2L' ELSE 'U2R' END
         WHEN event_type = 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'Malware' ELSE 'Command Control' END
         WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 'DoS' ELSE 'DDoS' END END AS attack_type,
    CAST(50 + k % 51 AS DOUBLE) / 100 AS confidence_score,
    CASE WHEN event_id % 3 = 0 THEN 'rf-1.0.0' ELSE 'rf-1.1.0' END AS model_version
  FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS INT) AS k FROM events)
)"""


def _duck_alerts(source: str) -> str:
    return f"""SELECT record_id, ts, source_ip, destination_ip, source_port, destination_port, protocol,
  packet_size, duration, attack_type, confidence_score, model_version,
  CASE
    WHEN confidence_score >= 0.9 AND attack_type IN ('DoS','R2L','Brute Force') THEN 'HIGH'
    WHEN confidence_score >= 0.9 AND attack_type IN ('DDoS','U2R','Malware') THEN 'CRITICAL'
    WHEN confidence_score >= 0.9 AND attack_type IN ('Probe','Port Scan') THEN 'MEDIUM'
    WHEN confidence_score >= 0.7 AND attack_type IN ('DDoS','U2R','Malware') THEN 'HIGH'
    WHEN confidence_score >= 0.5 AND attack_type IN ('Probe','Port Scan') THEN 'LOW'
    WHEN confidence_score >= 0.9 THEN 'HIGH'
    WHEN confidence_score >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS severity
FROM {source}
WHERE is_malicious AND (confidence_score >= 0.9
   OR (confidence_score >= 0.7 AND attack_type IN ('DDoS','U2R','Malware'))
   OR (confidence_score >= 0.5 AND attack_type IN ('Probe','Port Scan')))"""


DUCK = {
    "traffic": _duck_traffic("TIMESTAMP '2024-01-01 00:00:00' + (event_id * 4) * INTERVAL '1' SECOND"),
    "traffic_slow": _duck_traffic("ts"),
    "predictions": "SELECT record_id, ts, is_malicious, attack_type, confidence_score, model_version,"
                   " k + 5 AS processing_time_ms FROM traffic",
    "predictions_slow": "SELECT record_id, ts, is_malicious, attack_type, confidence_score,"
                        " model_version, k + 5 AS processing_time_ms FROM traffic_slow",
    "prediction_log": "SELECT record_id, ts, is_malicious, attack_type, confidence_score, model_version,"
                      " (is_malicious <> (k % 10 = 0)) AS actual_label, k + 20 AS response_time_ms"
                      " FROM traffic_slow",
    "alerts": _duck_alerts("traffic"),
    "alerts_slow": _duck_alerts("traffic_slow"),
    "corr_events": """SELECT record_id AS event_id, * EXCLUDE (record_id),
      CASE WHEN attack_type IN ('Probe','Port Scan') THEN 0 WHEN attack_type IN ('R2L','U2R','Brute Force') THEN 3
           WHEN attack_type = 'Malware' THEN 4 WHEN attack_type = 'Command Control' THEN 5 ELSE 6 END AS stage_idx,
      CASE WHEN attack_type IN ('Probe','Port Scan') THEN 'reconnaissance'
           WHEN attack_type IN ('R2L','U2R','Brute Force') THEN 'exploitation'
           WHEN attack_type = 'Malware' THEN 'installation'
           WHEN attack_type = 'Command Control' THEN 'command_control' ELSE 'actions_objectives' END AS stage,
      CASE severity WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END AS sev_idx
      FROM alerts""",
    "few_events": """SELECT * REPLACE ('192.168.' || split_part(source_ip, '.', 3) || '.'
      || CAST(split_part(source_ip, '.', 4) AS INT) % greatest((SELECT count(*) FROM corr_events) // 200, 1) AS source_ip) FROM corr_events""",
    "geo_ranges": """SELECT b.range_start, b.range_start + 255 AS range_end, n_name AS country
      FROM nation JOIN (VALUES (0, 3232235520), (1, 3232235776), (2, 3232236032), (3, 3232236288),
                               (4, 167772160)) b(n, range_start) ON b.n = n_nationkey""",
    "indicators": """SELECT source_ip AS indicator, 'ip' AS indicator_type, threat_type, 0.8::DOUBLE AS confidence, source
      FROM (SELECT DISTINCT source_ip, CAST(split_part(source_ip, '.', 4) AS INT) AS octet FROM traffic),
           (VALUES (7, 'abuse_ch', 'botnet'), (14, 'tor_exit_nodes', 'tor')) f(m, source, threat_type)
      WHERE octet % m = 0""",
}
_NEEDS = {
    "predictions": ["traffic"], "predictions_slow": ["traffic_slow"],
    "prediction_log": ["traffic_slow"], "alerts": ["traffic"], "alerts_slow": ["traffic_slow"],
    "corr_events": ["traffic", "alerts"], "few_events": ["traffic", "alerts", "corr_events"], "indicators": ["traffic"],
}


def duck(names: str, body: str) -> str:
    """Prefix ``body`` with the named views (and what they need) as CTEs.

    ``body`` may itself start with ``WITH``; its CTEs are appended to the list.
    """
    wanted: list[str] = []
    for name in names.split():
        for need in [*_NEEDS.get(name, []), name]:
            if need not in wanted:
                wanted.append(need)
    ctes = ",\n".join(f"{n} AS ({DUCK[n]})" for n in wanted)
    body = body.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        rest = body[len("WITH RECURSIVE"):] if recursive else body[len("WITH"):]
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes},\n{rest.strip()}"
    return f"WITH {ctes}\n{body}"
