"""Streaming queries: each drains the events file stream and returns what was written."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tarnwatch.operators import alerts as A
from tarnwatch.operators import behavior as B
from tarnwatch.operators import correlate as C
from tarnwatch.plans import alerting, correlation
from tarnwatch.plans.support import Book, rounded
from tarnwatch.plans.views import duck, traffic_stream
from tarnwatch.sources.tables import read_generation
from tarnwatch.streaming import streams as S

book = Book()
add = book.add
PAIR = ("source_ip", "destination_ip")


def _alerts(s, d):
    return A.alert_rows(traffic_stream(s, d))


def _events(s, d):
    return C.with_stage(_alerts(s, d).withColumnRenamed("record_id", "event_id"))


def _parsed(s, d):
    fields = ["record_id", "ts", "source_ip", "destination_ip", "source_port", "destination_port", "protocol",
              F.col("packet_size").cast("long").alias("packet_size"), "duration", "flags", "features", F.col("attack_type").alias("label")]
    messages = traffic_stream(s, d).select(F.to_json(F.struct(*fields)).alias("value"))
    return S.drain(S.parse_messages(messages), "messages").select(
        "record_id", "source_ip", "destination_port", "packet_size", "label", F.array_join("flags", ",").alias("flags"))


add("stream_traffic", _parsed,
    duck("traffic", "SELECT record_id, source_ip, destination_port, packet_size::BIGINT AS packet_size, attack_type AS label, flags_csv AS flags FROM traffic"))
add("drop_aged",
    lambda s, d: S.drain(S.drop_aged(traffic_stream(s, d).withColumn(
        "ingest_ts", F.timestamp_micros(F.unix_micros("ts") + F.col("k") * 100_000)), 5), "aged").select("record_id", "source_ip"),
    duck("traffic", "SELECT record_id, source_ip FROM traffic WHERE k * 100000 <= 5000000"))
add("dedup_alert_stream",
    lambda s, d: S.drain(S.dedup_alert_stream(_alerts(s, d)), "dedup").select("record_id", "source_ip", "attack_type"),
    alerting.ORACLE["dedup_alerts"])
add("flow_stream",
    lambda s, d: rounded(S.drain(S.flow_stream(traffic_stream(s, d), flow_cols=PAIR), "flows")).withColumn("flags", F.array_join("flags", ",")),
    duck("traffic", """WITH pk AS (SELECT *, concat_ws('|', source_ip, destination_ip) AS fk FROM traffic),
      gaps AS (SELECT *, lag(ts) OVER (PARTITION BY fk ORDER BY ts, record_id) AS prev FROM pk),
      sess AS (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > 300000000 THEN 1 ELSE 0 END) OVER (PARTITION BY fk ORDER BY ts, record_id) AS sid FROM gaps)
      SELECT fk AS flow_key, count(*) AS packet_count, sum(packet_size)::BIGINT AS total_bytes, min(ts) AS start_time, max(ts) AS last_time,
        array_to_string(list_sort(list_distinct(flatten(list(string_split(flags_csv, ','))))), ',') AS flags, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS duration FROM sess
      GROUP BY fk, sid HAVING epoch_us(max(ts)) + 300000001 <= (SELECT epoch_us(max(ts)) FROM traffic)"""))
add("coordinated_stream", lambda s, d: S.drain(S.coordinated_stream(_alerts(s, d)), "coordinated"),
    duck("alerts", """SELECT date_trunc('hour', ts) AS hour, count(DISTINCT source_ip) AS sources, count(*)::BIGINT AS events FROM alerts
      GROUP BY 1 HAVING count(DISTINCT source_ip) > 5 AND count(*) > 20
        AND date_trunc('hour', ts) + INTERVAL '1' HOUR <= (SELECT max(ts) FROM alerts) - INTERVAL '10' MINUTE"""))
add("rates_stream",
    lambda s, d: rounded(S.drain(S.rates_stream(traffic_stream(s, d)), "rates")),
    duck("traffic", """WITH ends AS (SELECT DISTINCT date_trunc('minute', ts) + i * INTERVAL '1' MINUTE AS e FROM traffic, generate_series(1, 5) g(i))
      SELECT e AS "end", round(count(*) / 300.0::DOUBLE, 6) AS request_rate, round((count(*) FILTER (WHERE is_malicious)) / 300.0::DOUBLE, 6) AS threat_rate
      FROM ends JOIN traffic ON ts < e AND ts >= e - INTERVAL '5' MINUTE GROUP BY 1 HAVING e <= (SELECT max(ts) FROM traffic) - INTERVAL '1' MINUTE"""))
for _r in (correlation.RECON, correlation.MULTI, correlation.COORD):
    add(f"correlate_stream_{_r.rule_id}",
        lambda s, d, r=_r: S.drain(S.correlate_stream(_events(s, d), r), "correlate").select(
            "event_id", "rule_id", F.array_join(F.transform("matched", lambda x: x.cast("string")), ",").alias("matched")),
        duck("corr_events", f"WITH {correlation._RULES} SELECT anchor AS event_id, rule_id, matched FROM ma WHERE rule_id = '{_r.rule_id}'"))


def _profiles(s, d):
    folder = S.work_folder(s, "profiles")
    S.profile_stream(traffic_stream(s, d, slow=True), f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return rounded(B.finish(read_generation(s, f"{folder}/table")[0].drop("_checkpoint", "_batch")).drop("sum_squares"))


def _record_alerts(s, d):
    """Two feeds into one profile table: the packets of the first ten days, then the others."""
    folder, border = S.work_folder(s, "record_alerts"), F.lit(datetime(2024, 1, 11))
    for name, part in (("old", F.col("ts") < border), ("new", F.col("ts") >= border)):
        S.profile_stream(traffic_stream(s, d, slow=True).where(part), f"{folder}/table", f"{folder}/{name}",
                         alerts=f"{folder}/alerts", min_obs=5).awaitTermination()
    # means of few decimals lie on rounding borders: both engines round a little above them
    return rounded(S.stored_alerts(s, f"{folder}/alerts").withColumn("baseline_value", F.col("baseline_value") + 1e-9))


def _stats(s, d):
    folder = S.work_folder(s, "stats")
    S.record_stats(traffic_stream(s, d), f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return S.stream_stats(s, f"{folder}/table").drop("mean_batch_seconds")


def _register_profiles():
    from tarnwatch.plans import behaviour
    add("profile_stream", _profiles, behaviour.ORACLE["behavior_profiles"])
    add("record_alert_stream", _record_alerts, duck("traffic_slow", f"""WITH {behaviour._OBS},
      su AS (SELECT *, count(value) OVER w AS n, sum(value::DOUBLE) OVER w AS s, sum(value::DOUBLE * value) OVER w AS q FROM ob
        WINDOW w AS (PARTITION BY entity_id, feature ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      va AS (SELECT *, s / n AS m, (q - s * s / n) / (n - 1) AS var FROM su WHERE n >= 5 AND q - s * s / n > q * 1e-12),
      zs AS (SELECT *, abs(value - m) / sqrt(var) AS z FROM va)
      SELECT record_id, ts, entity_id, feature, 'statistical_deviation' AS anomaly_type,
        CASE WHEN z > 4 THEN 'critical' WHEN z > 3 THEN 'high' ELSE 'medium' END AS severity, round(least(z / 5, 1.0), 6) AS anomaly_score,
        round(m + 1e-9, 6) AS baseline_value, round(value, 6) AS observed_value, round(z, 6) AS z_score, n AS profile_count FROM zs WHERE z > 2"""))


_register_profiles()
add("stream_stats", _stats,
    duck("traffic", """SELECT count(*) AS processed, count(*) AS classified, count(*) FILTER (WHERE is_malicious) AS malicious, 0::BIGINT AS errors FROM traffic"""))

QUERIES, ORACLE = book.queries, book.oracle
