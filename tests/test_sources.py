"""Readers, writers and stateful tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.operators import quality as Q
from tarnwatch.sources import datasets as D
from tarnwatch.sources import rules as R
from tarnwatch.sources import tables as T


def nsl_line(label, difficulty=None):
    values = ["0", "tcp", "http", "SF"] + ["1"] * 37 + [label] + ([str(difficulty)] if difficulty is not None else [])
    return ",".join(values)


def test_nsl_kdd(spark, tmp_path):
    path = tmp_path / "kdd.txt"
    path.write_text("\n".join([nsl_line("normal", 20), nsl_line("neptune.", 15), nsl_line("unheard", 3)]))
    df = D.read_nsl_kdd(spark, str(path))
    assert len(df.columns) == 43 and df.columns[:3] == K.NSL_KDD_FEATURES[:3]
    Q.validate_dataset_schema(df, "nsl_kdd")
    got = {r["attack_type"]: r["attack_category"] for r in Q.add_attack_category(df, "nsl_kdd").collect()}
    assert got == {"normal": "normal", "neptune": "dos", "unheard": "unknown"}
    (tmp_path / "short.txt").write_text("1,2,3\n")
    with pytest.raises(D.DataLoadError, match="Unexpected number of columns"):
        D.read_nsl_kdd(spark, str(tmp_path / "short.txt"))
    plain = tmp_path / "plain.txt"
    plain.write_text(nsl_line("smurf"))
    assert len(D.read_nsl_kdd(spark, str(plain)).columns) == 42
    ready = Q.preprocess_for_ml(df, "nsl_kdd")
    assert "difficulty_score" not in ready.columns


@pytest.mark.parametrize("label", ["normal", "neptune", "smurf", "back", "teardrop", "ipsweep", "nmap", "portsweep", "satan",
                                   "buffer_overflow", "loadmodule", "perl", "rootkit", "ftp_write", "guess_passwd", "imap",
                                   "multihop", "phf"])
def test_nsl_labels_are_known(label):
    assert any(label in names for names in K.NSL_KDD_CATEGORIES.values())


@pytest.mark.parametrize("label", ["benign", "ddos", "dos hulk", "dos goldeneye", "dos slowhttptest", "port scan",
                                   "brute force -web", "sql injection", "infiltration", "bot", "heartbleed"])
def test_cicids_labels_are_known(label):
    assert any(label in names for names in K.CICIDS_CATEGORIES.values())


def test_cicids(spark, tmp_path):
    names = [" Destination Port", " Flow Duration", "Flow Bytes/s", " Label"]
    (tmp_path / "c.csv").write_text(",".join(names) + "\n80,5,Infinity,BENIGN\n443,7,NaN,DDoS\n22,-1,2.5,PortScan\n")
    df = D.read_cicids(spark, str(tmp_path / "c.csv"))
    assert df.columns == ["destination_port", "flow_duration", "flow_bytes_s", "label"]
    rows = df.orderBy("destination_port").collect()
    assert [r["label"] for r in rows] == ["portscan", "benign", "ddos"]
    assert [r["flow_bytes_s"] for r in rows] == [2.5, None, None]
    assert D.read_cicids(spark, str(tmp_path / "c.csv"), max_rows=2).count() == 2
    assert {r["column"]: r["negatives"] for r in Q.check_ranges(df).collect()} == {"flow_duration": 1}
    with pytest.raises(ValueError, match="Insufficient features"):
        Q.validate_dataset_schema(df, "cicids")
    assert set(Q.standardize_features(df, K.FEATURE_RENAMES["cicids"]).columns) >= {"dst_port", "duration"}


def test_safe_load(spark, tmp_path):
    with pytest.raises(D.DataLoadError, match="does not exist"):
        D.safe_load(D.read_nsl_kdd, spark, str(tmp_path / "none"))
    (tmp_path / "empty.csv").write_text("a,Label\n")
    with pytest.raises(D.DataLoadError, match="No rows"):
        D.safe_load(D.read_cicids, spark, str(tmp_path / "empty.csv"))
    (tmp_path / "ok.csv").write_text("a,Label\n1,X\n1,X\n")
    df, stats = D.safe_load(D.read_cicids, spark, str(tmp_path / "ok.csv"), with_stats=True)
    assert df.count() == 2 and stats.first()["duplicates"] == 1


def test_column_helpers(spark):
    assert Q.clean_names([" Flow Bytes/s", "Flow-Bytes/s", "", "__A__b", "a b"]) == [
        "flow_bytes_s", "flow_bytes_s_1", "column_2", "a_b", "a_b_1"]
    df = spark.createDataFrame([(1, "x")], "n int, Class string")
    assert Q.standardize_target(df).columns == ["n", "label"]
    with pytest.raises(ValueError, match="Missing required columns"):
        Q.validate_required_columns(df, ["n", "gone"])
    assert Q.validate_data_types(df, {"n": "categorical", "Class": "categorical"}) == ["column n is not categorical"]


def test_rules_and_indicators(spark, tmp_path):
    rule = {"rule_id": "r1", "name": "n", "description": "d", "severity": "LOW", "rule_type": "yara", "pattern": "p"}
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"rules": [rule, {**rule, "rule_id": "r2", "enabled": False, "metadata": {"a": "b"}}]}, indent=1))
    rows = R.read_rules_json(spark, str(path)).collect()
    assert [(r["rule_id"], r["enabled"], r["metadata"]) for r in rows] == [("r1", True, {}), ("r2", False, {"a": "b"})]
    assert R.read_rules_json(spark, str(tmp_path / "missing.json")).count() == 0
    (tmp_path / "ips.txt").write_text("# list\n\n192.168.1.1 \n10.0.0.1\n;kept\n")
    assert R.read_indicators(spark, str(tmp_path / "ips.txt")).count() == 3
    assert R.read_indicators(spark, str(tmp_path / "ips.txt"), feed=True).count() == 2


def test_upsert_generations(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, at int")
    T.upsert(spark, path, first, ["k"], "at")
    T.upsert(spark, path, spark.createDataFrame([("a", 2, 2), ("b", 0, 0), ("c", 3, 1)], "k string, v int, at int"), ["k"], "at")
    df, number = T.read_generation(spark, path)
    assert number == 2 and {r["k"]: r["v"] for r in df.collect()} == {"a": 2, "b": 1, "c": 3}
    same = T.latest_rows([first, first.withColumn("v", F.lit(9))], ["k"], "at")
    assert {r["v"] for r in same.collect()} == {9}
    # a half-written generation is ignored
    (tmp_path / "t" / "gen=000003").mkdir()
    assert T.read_generation(spark, path)[1] == 2


def traffic(spark):
    return spark.createDataFrame(
        [(i, dt.datetime(2024, 1, 1 + i % 3, 5), "10.0.0.1", "10.0.0.2", 1, 2, "TCP", 100, 0.1, ["SYN"], {"x": 1.0}) for i in range(6)],
        "record_id long, ts timestamp, source_ip string, destination_ip string, source_port int, destination_port int, protocol string,"
        " packet_size int, duration double, flags array<string>, features map<string,double>")


def test_logs_and_observations(spark, tmp_path):
    t = traffic(spark)
    pred = t.select("record_id", "ts", F.lit(True).alias("is_malicious"))
    for _ in range(2):
        T.append_prediction_log(pred, t, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 12 and log.where("date = '2024-01-02'").first()["features"] == {"x": 1.0}
    T.append_observations(t, str(tmp_path / "obs"))
    found = T.read_observations(spark, str(tmp_path / "obs"), dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2, 23))
    assert found.count() == 2 and found.first()["observation"]["x"] == 1.0
    assert "PartitionFilters: [isnotnull(date" in found._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_report_and_export(spark, tmp_path):
    section = spark.createDataFrame([("DoS", {"a": 1}, [1, 2])], "name string, m map<string,int>, l array<int>")
    T.write_report({"types": section}, str(tmp_path / "rep"))
    back = T.read_report(spark, str(tmp_path / "rep"), {"types": section.schema})["types"].first()
    assert (back["name"], back["m"], back["l"]) == ("DoS", {"a": 1}, [1, 2])
    T.export(section.select("name"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["name"] == "DoS"
    T.export(section.select("name"), str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    with pytest.raises(ValueError):
        T.export(section, str(tmp_path / "x"), "xls")


def test_rule_file_of_one_family(spark, tmp_path):
    path = tmp_path / "family.json"
    path.write_text(json.dumps({"rules": [{"rule_id": "a", "name": "n", "severity": "LOW", "pattern": "rule z { condition: filesize > 1 }"},
                                          {"rule_id": "b", "name": "n", "severity": "LOW", "rule_type": "snort", "pattern": "p"}]}))
    assert [r["rule_type"] for r in R.read_rules_json(spark, str(path), family="yara").collect()] == ["yara", "snort"]
    with pytest.raises(Exception, match="no family given for rule a"):
        R.read_rules_json(spark, str(path)).collect()
