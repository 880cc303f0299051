"""Evaluation, monitoring and behaviour operators with known values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarnwatch.operators import behavior as B
from tarnwatch.operators import models as M
from tarnwatch.operators import monitor as D
from tarnwatch.operators import intel as I

NOW = dt.datetime(2024, 2, 1)


def test_binary_metrics(spark):
    pred = spark.createDataFrame(list(zip([0, 1, 1, 1, 0], [0, 1, 0, 1, 0])), "label int, prediction int")
    m = M.classification_metrics(pred).first()
    assert m["accuracy"] == pytest.approx(0.8) and m["recall_macro"] == pytest.approx((1 + 2 / 3) / 2)
    c = {r["label"]: r for r in M.confusion_matrix(pred).collect()}
    assert (c[1]["tp"], c[1]["fp"], c[1]["fn"], c[1]["tn"]) == (2, 0, 1, 2)


def test_auc(spark):
    df = spark.createDataFrame([(0, .1), (0, .4), (1, .35), (1, .8)], "label int, score double")
    r = M.roc_pr_summary(M.roc_pr_points(df)).first()
    assert r["auc"] == pytest.approx(0.75) and r["average_precision"] == pytest.approx(0.8333333)


def test_training_and_scoring(spark):
    df = spark.range(400).select(F.col("id").alias("record_id"), F.lit(NOW).alias("ts"), (F.col("id") % 20).cast("double").alias("a"),
                                 F.rand(1).alias("b"), F.when(F.col("id") % 20 >= 10, "attack").otherwise("normal").alias("kind"))
    with pytest.raises(ValueError, match="Unsupported algorithm"):
        M.train_models(df, "kind", ["a", "b"], ["magic"])
    model = M.train_models(df, "kind", ["a", "b"], ["random_forest"])["random_forest"]
    scored = M.score_batch(model, df, ["attack", "normal"], "v1")
    assert scored.where("is_malicious").count() == 200 and scored.where("attack_type = 'attack'").count() == 200
    imp = M.intrinsic_importance(model, ["a", "b"])
    assert sum(imp.values()) == pytest.approx(1.0) and imp["a"] > imp["b"]
    perm = {r["feature"]: r["importance"] for r in M.permutation_importance(
        model, M.indexed(df, "kind", ["attack", "normal"]), "label", ["a", "b"], "record_id").collect()}
    assert perm["a"] > 0.3 > perm["b"]


def log(spark):
    rows = [("p1", True, True, .9, 50.0), ("p2", False, False, .8, 45.0), ("p3", True, False, .7, 40.0), ("p4", False, True, .6, 40.0)]
    return spark.createDataFrame([("m", *r, NOW) for r in rows], "model_version string, id string, is_malicious boolean, actual_label boolean,"
                                 " confidence_score double, response_time_ms double, ts timestamp")


def test_prediction_performance(spark):
    r = D.prediction_performance(log(spark)).first()
    assert r["accuracy"] == .5 and r["precision"] == .5 and r["recall"] == .5
    assert r["avg_confidence"] == pytest.approx(.75) and r["avg_response_time_ms"] == pytest.approx(43.75)


def history(spark, recent):
    rows = [("m", "accuracy", NOW - dt.timedelta(days=10) + dt.timedelta(hours=i), 0.95 + 0.001 * i, 200) for i in range(5)]
    rows += [("m", "accuracy", NOW - dt.timedelta(days=2) + dt.timedelta(hours=i), recent + 0.001 * i, 200) for i in range(5)]
    return spark.createDataFrame(rows, "model_version string, metric_name string, ts timestamp, metric_value double, sample_count long")


def test_drift(spark):
    r = D.detect_drift(history(spark, 0.75), NOW).collect()
    assert len(r) == 1 and r[0]["severity"] == "high" and r[0]["current_value"] < r[0]["baseline_value"]
    assert r[0]["p_value"] == pytest.approx(0.01219, abs=2e-4)
    assert D.detect_drift(history(spark, 0.95), NOW).count() == 0


@pytest.mark.parametrize("score,now,before,severity,words", [
    (.35, .6, .9, "critical", "Immediate retraining required"), (.25, .7, .9, "high", "24 hours"),
    (.15, .8, .9, "medium", "48-72 hours"), (.15, .9, .8, "low", "Monitor trend"), (.05, .85, .9, "low", "Monitor trend")])
def test_drift_severity(spark, score, now, before, severity, words):
    df = spark.createDataFrame([(score, now, before, "accuracy")], "drift_score double, current_value double, baseline_value double, metric_name string")
    r = D.drift_severity(df).first()
    assert r["severity"] == severity and words in r["recommendation"]


def test_recent_drift_alerts(spark):
    df = spark.createDataFrame([(f"a{i}", NOW - dt.timedelta(hours=i), "m") for i in range(3)], "alert_id string, ts timestamp, model_version string")
    assert [r["alert_id"] for r in D.recent_drift_alerts(df, NOW).collect()] == ["a0", "a1", "a2"]
    assert D.recent_drift_alerts(df, NOW, 1).count() == 1


def test_profiles_use_sample_deviation(spark):
    obs = spark.createDataFrame([("e", NOW, i, "f", float(v)) for i, v in enumerate([1, 2, 3, 4])],
                                "entity_id string, ts timestamp, record_id long, feature string, value double")
    r = B.finish(B.profile_parts(obs)).first()
    assert r["mean"] == 2.5 and r["std"] == pytest.approx(1.2909944)
    one = B.finish(B.profile_parts(obs.limit(1))).first()
    assert one["std"] == 0.0


def test_isolation_forest_finds_the_outlier():
    import numpy as np
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(size=(200, 3)), [[9.0, 9.0, 9.0]]]
    scores = B.isolation_scores(x, 42)
    assert scores.argmax() == 200 and scores[200] > 0.6 and 0.3 < np.median(scores) < 0.6


def test_isolation_forest_is_one_for_any_size(spark, monkeypatch):
    base = dt.datetime(2024, 2, 1)
    rows = [(i, base + dt.timedelta(seconds=i), "1.1.1.1" if i % 3 else "2.2.2.2", "3.3.3.3", 1000 + i * 7919 % 60000, [80, 443, 22][i % 3],
             ["TCP", "UDP"][i % 2], 60 + i * i % 1400, i % 11 / 7, ["SYN", "ACK"]) for i in range(1500)]
    df = spark.createDataFrame(rows, "record_id long, ts timestamp, source_ip string, destination_ip string, source_port int, destination_port int, "
                                     "protocol string, packet_size int, duration double, flags array<string>")
    run = lambda: sorted((r.record_id, round(r.anomaly_score, 9)) for r in B.isolation_forest_anomalies(df, base, 24).collect())
    for pool in (25_600, 400):
        monkeypatch.setattr(B, "POOL", pool, raising=False)
        monkeypatch.setattr(B, "MAX_ENTITY_ROWS", 50_000)
        whole = run()
        monkeypatch.setattr(B, "MAX_ENTITY_ROWS", 200)
        assert run() == whole and 100 <= len(whole) <= 150


def test_threat_patterns(spark):
    rows = [("1.1.1.1", k, NOW + dt.timedelta(minutes=i)) for i, k in enumerate(["scanner", "dos", "exploit"])]
    rows += [("2.2.2.2", "dos", NOW + dt.timedelta(minutes=i)) for i in range(15)]
    rows += [(f"3.3.3.{j}", "dos", NOW + dt.timedelta(minutes=i)) for j in range(10) for i in range(3)]
    df = spark.createDataFrame(rows, "source_ip string, attack_type string, ts timestamp")
    got = sorted((r["pattern_type"], r["subject"], r["occurrence_count"]) for r in I.threat_patterns(df).collect())
    assert got == [("attack_sequence", "1.1.1.1", 1), ("behavioral", "2.2.2.2", 15), ("temporal", "2024-02-01 00", 48)]


def test_geolocate_prefers_the_narrowest_range(spark):
    ranges = spark.createDataFrame([(0, 4294967295, "wide"), (167772160, 167772415, "narrow")], "range_start long, range_end long, country string")
    ips = spark.createDataFrame([("10.0.0.7",), ("10.0.1.7",), ("::1",)], "ip string")
    assert {r["ip"]: r["country"] for r in I.geolocate(ips, ranges, "ip").collect()} == {"10.0.0.7": "narrow", "10.0.1.7": "wide", "::1": None}


def test_training_rows_are_spread(spark, monkeypatch):
    df = spark.range(90, numPartitions=1).withColumn("x", F.col("id") * 2)
    assert M.spread_rows(df).rdd.getNumPartitions() == 1
    monkeypatch.setattr(M, "PART_ROWS", 20)
    wide = M.spread_rows(df)
    assert wide.rdd.getNumPartitions() == 5 and sorted(wide.collect()) == sorted(df.collect())
