"""Threat report: sections from one aggregate, counted against a plain loop."""

import datetime as dt
from collections import Counter

from tarnwatch import constants as K
from tarnwatch.operators import reports as R
from tarnwatch.plans import reporting

START, END = dt.datetime(2024, 1, 1, 0, 30), dt.datetime(2024, 1, 1, 4, 30)
SCHEMA = "ts timestamp, attack_type string, severity string, confidence_score double, source_ip string, destination_ip string"


def test_threat_report(spark, tmp_path):
    rows = [(START + dt.timedelta(minutes=i % 200), ["DoS", "Probe", None][i % 3], ["LOW", "HIGH"][i % 2], 0.95, f"s{i % 4}", "t") for i in range(400)]
    rows.append((END + dt.timedelta(minutes=1), "late", "LOW", 0.1, "s", "t"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "alerts"))
    report = R.threat_report(spark.read.parquet(str(tmp_path / "alerts")), START, END, 2)
    assert report._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 3
    got = {(r.section, r["item"]): r.n for r in report.collect()}
    inside = rows[:-1]
    want = Counter(("type", r[1]) for r in inside) + Counter(("severity", r[2]) for r in inside)
    want += Counter(("hour", r[0].strftime("%Y-%m-%d %H")) for r in inside)
    want |= {("total", "threats"): 400, ("source", "s0"): 100, ("source", "s1"): 100, ("target", "t"): 400}
    want = dict(want) | {("hour", "2024-01-01 04"): 0}
    bins = {k: n for k, n in got.items() if k[0] == "confidence"}
    assert {k: n for k, n in got.items() if k[0] != "confidence"} == want
    assert len(bins) == len(K.CONFIDENCE_BINS) + 1 and sorted(bins.values()) == [0] * len(K.CONFIDENCE_BINS) + [400]


def test_threat_report_of_no_alerts(spark):
    got = {(r.section, r["item"]): r.n for r in R.threat_report(spark.createDataFrame([], SCHEMA), START, END).collect()}
    assert got[("total", "threats")] == 0 and set(got.values()) == {0}
    assert {s for s, _ in got} == {"total", "hour", "confidence"}


def test_confidence_distribution(spark, tmp_path):
    events = [(i, dt.datetime(2024, 1, 1), i, "click", 1.0, '{"k": %d}' % k) for i, k in enumerate([50, 40, 39, 20, 0, 1])]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(
        str(tmp_path / "events.parquet"))
    got = {r["bin"]: r["n"] for r in reporting.QUERIES["confidence_distribution"](spark, str(tmp_path)).collect()}
    assert got == {"0.9-1.0": 2, "0.8-0.9": 1, "0.7-0.8": 1, "0.6-0.7": 0, "0.5-0.6": 2, "0.0-0.5": 0}
