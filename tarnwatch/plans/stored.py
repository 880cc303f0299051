"""Queries that go through files: readers, appended logs, upserted tables, reports and exports.

The files are written from the test tables first, so the work grows with them.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.operators import alerts as A
from tarnwatch.operators import models as M
from tarnwatch.operators import monitor as D
from tarnwatch.operators import reports as R
from tarnwatch.plans import modelling, preparation
from tarnwatch.plans.support import Book, rounded
from tarnwatch.plans.views import alerts, duck, prediction_log, predictions_slow, traffic, traffic_slow, traffic_stream
from tarnwatch.sources import datasets, rules, tables
from tarnwatch.streaming import streams as S

book = Book()
add = book.add


def _nsl(s, d):
    folder = S.work_folder(s, "nsl")
    zeros = [F.lit("0")] * (len(K.NSL_KDD_FEATURES) - 6)
    line = F.concat_ws(",", F.col("duration").cast("string"), F.lower("protocol"), F.lit("http"), F.col("flags_csv").substr(1, 3),
                       F.col("packet_size").cast("string"), F.col("k").cast("string"), *zeros, F.expr(preparation._LBL + " || '.'"),
                       (F.col("k") % 21).cast("string"))
    traffic(s, d).select(line.alias("value")).write.text(folder)
    df = datasets.safe_load(datasets.read_nsl_kdd, s, folder)
    return rounded(df.groupBy("attack_type", "protocol_type", "flag").agg(
        F.count("*").alias("n"), F.sum("src_bytes").alias("src_bytes"), F.sum("duration").alias("duration"), F.sum("difficulty_score").alias("difficulty")))


add("read_nsl_kdd", _nsl,
    duck("traffic", f"""SELECT {preparation._LBL} AS attack_type, lower(protocol) AS protocol_type, flags_csv[1:3] AS flag, count(*) AS n,
      sum(packet_size)::DOUBLE AS src_bytes, round(sum(duration), 6) AS duration, sum(k % 21)::BIGINT AS difficulty FROM traffic GROUP BY 1, 2, 3"""))


def _cicids(s, d):
    folder = S.work_folder(s, "cicids")
    t = traffic(s, d)
    t.select(F.col("destination_port").alias(" Destination Port"), F.col("packet_size").alias("Total Length of Fwd Packets"),
             F.when(F.col("k") % 10 == 0, "Infinity").when(F.col("k") % 11 == 0, "NaN").otherwise(F.col("k").cast("string")).alias("Flow Bytes/s"),
             F.when(F.col("is_malicious"), "DDoS").otherwise("BENIGN").alias(" Label")).write.option("header", True).csv(folder)
    df = datasets.safe_load(datasets.read_cicids, s, folder)
    return df.groupBy("label", "destination_port").agg(F.count("*").alias("n"), F.sum("total_length_of_fwd_packets").alias("bytes"),
                                                       F.count("flow_bytes_s").alias("known"), F.sum("flow_bytes_s").alias("rate"))


add("read_cicids", _cicids,
    duck("traffic", """SELECT CASE WHEN is_malicious THEN 'ddos' ELSE 'benign' END AS label, destination_port::DOUBLE AS destination_port, count(*) AS n,
      sum(packet_size)::DOUBLE AS bytes, count(*) FILTER (WHERE k % 10 <> 0 AND k % 11 <> 0) AS known, (sum(k) FILTER (WHERE k % 10 <> 0 AND k % 11 <> 0))::DOUBLE AS rate
      FROM traffic GROUP BY 1, 2"""))


def _rules(s, d):
    """One rule per destination port (at most 65 536), written as a rule file and read back."""
    folder = S.work_folder(s, "rules")
    port = F.col("destination_port").cast("string")
    rule = F.struct(port.alias("rule_id"), F.concat(F.lit("Watch "), port).alias("name"), F.lit("HIGH").alias("severity"),
                    F.lit("custom").alias("rule_type"), F.format_string('{"destination_port": %s}', port).alias("pattern"),
                    F.when(port.endswith("3"), False).alias("enabled"))
    table = traffic(s, d).select("destination_port").distinct().groupBy().agg(F.array_sort(F.collect_list(rule)).alias("rules"))
    table.write.json(folder)
    return rules.read_rules_json(s, folder).select("rule_id", "name", "severity", "pattern", "enabled")


add("read_rules_json", _rules,
    duck("traffic", """SELECT p AS rule_id, 'Watch ' || p AS name, 'HIGH' AS severity, '{"destination_port": ' || p || '}' AS pattern, p NOT LIKE '%3' AS enabled
      FROM (SELECT DISTINCT destination_port::VARCHAR AS p FROM traffic)"""))


def _upserted(s, d):
    folder = S.work_folder(s, "upsert")
    t = traffic_slow(s, d).select("source_ip", "protocol", "ts", "record_id", "packet_size")
    for part in range(3):
        batch = t.where(F.col("record_id") % 3 == part)
        newest = batch.groupBy("source_ip", "protocol").agg(F.max("ts").alias("ts"), F.max_by(
            F.struct("record_id", "packet_size"), "ts").alias("r")).select("source_ip", "protocol", "ts", "r.*")
        tables.upsert(s, folder, newest, ["source_ip", "protocol"], "ts")
    return tables.read_generation(s, folder)[0]


add("upsert_table", _upserted,
    duck("traffic_slow", """SELECT source_ip, protocol, max(ts) AS ts, arg_max(record_id, ts) AS record_id, arg_max(packet_size, ts) AS packet_size
      FROM traffic_slow GROUP BY 1, 2"""))


def _logged(s, d):
    folder = S.work_folder(s, "log")
    tables.append_prediction_log(predictions_slow(s, d), traffic_slow(s, d), folder)
    return s.read.parquet(folder).where("date = DATE '2024-01-05'").select(
        "record_id", "ts", "is_malicious", "source_ip", "destination_port", F.size("features").alias("features"))


add("append_prediction_log", _logged,
    duck("traffic_slow", "SELECT record_id, ts, is_malicious, source_ip, destination_port, 2 AS features FROM traffic_slow WHERE ts::DATE = DATE '2024-01-05'"))


def _observed(s, d):
    folder = S.work_folder(s, "observations")
    tables.append_observations(traffic_slow(s, d), folder)
    found = tables.read_observations(s, folder, datetime(2024, 1, 4, 12), datetime(2024, 1, 6, 6))
    return found.select("entity_id", "ts", F.col("observation")["packet_size"].alias("packet_size"), F.col("observation")["k_value"].alias("k_value"))


add("append_observations", _observed,
    duck("traffic_slow", """SELECT source_ip AS entity_id, ts, packet_size::DOUBLE AS packet_size, k::DOUBLE AS k_value FROM traffic_slow
      WHERE ts BETWEEN TIMESTAMP '2024-01-04 12:00:00' AND TIMESTAMP '2024-01-06 06:00:00'"""))


def _reported(s, d):
    folder = S.work_folder(s, "report")
    sections = {"types": R.threats_by_type(alerts(s, d)), "sources": R.source_ip_analysis(alerts(s, d))}
    tables.write_report(sections, folder)
    back = tables.read_report(s, folder, {name: df.schema for name, df in sections.items()})
    return back["types"].select(F.col("attack_type").alias("item"), F.col("n")).unionByName(
        back["sources"].select(F.col("source_ip").alias("item"), F.col("threats").alias("n")))


add("write_read_report", _reported,
    duck("alerts", "SELECT attack_type AS item, count(*) AS n FROM alerts GROUP BY 1 UNION ALL SELECT source_ip, count(*) FROM alerts GROUP BY 1"))


def _exported(fmt):
    def run(s, d):
        folder = S.work_folder(s, "export")
        df = alerts(s, d).select("record_id", "source_ip", "severity", "confidence_score")
        tables.export(df, folder, fmt)
        reader = s.read.schema(df.schema)
        return reader.csv(folder, header=True) if fmt == "csv" else reader.json(folder)
    return run


for _fmt in ("csv", "json"):
    add(f"export_{_fmt}", _exported(_fmt), duck("alerts", "SELECT record_id, source_ip, severity, confidence_score FROM alerts"))

add("model_performance",
    lambda s, d: rounded(R.model_performance(D.metric_history(prediction_log(s, d), "day"), datetime(2024, 1, 30), 48)).where(
        "metric_name = 'accuracy'").select("model_version", "ts", "metric_value", "sample_count"),
    duck("prediction_log", """SELECT model_version, date_trunc('day', ts) AS ts, round(avg((is_malicious = actual_label)::INT), 6) AS metric_value, count(*) AS sample_count
      FROM prediction_log GROUP BY 1, 2 HAVING date_trunc('day', ts) >= TIMESTAMP '2024-01-28 00:00:00'"""))


def _score_stream(s, d):
    model = modelling._forest(s, d)
    ready = modelling.features_of(traffic_stream(s, d))
    return S.drain(S.score_stream(ready, lambda df: M.score_batch(model, df, modelling.CLASSES, "rf-2.0.0")), "scores").select(
        "record_id", "is_malicious", "attack_type", "confidence_score")


add("score_stream", _score_stream)


def _acted(s, d):
    folder = S.work_folder(s, "actions")

    def raise_alerts(batch, batch_id):
        scored = batch.select("record_id", "ts", "is_malicious", "attack_type", "confidence_score")
        A.create_alerts(scored, batch).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    S.alert_actions(traffic_stream(s, d), raise_alerts, f"{folder}/checkpoint").awaitTermination()
    return s.read.parquet(f"{folder}/out").select("record_id", "severity", "attack_type")


add("alert_actions", _acted, duck("alerts", "SELECT record_id, severity, attack_type FROM alerts"))

QUERIES, ORACLE = book.queries, book.oracle
