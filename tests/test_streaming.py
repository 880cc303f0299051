"""Streams fed in several micro-batches give the batch results."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tarnwatch.operators import alerts as A
from tarnwatch.operators import behavior as B
from tarnwatch.operators import correlate as C
from tarnwatch.operators import flows as W
from tarnwatch.sources.tables import read_generation
from tarnwatch.streaming import streams as S

BASE = dt.datetime(2024, 1, 1)
TYPES = ["Probe", "Port Scan", "Brute Force", "Malware", "DoS"]
SCHEMA = ("record_id long, ts timestamp, source_ip string, destination_ip string, source_port int, destination_port int, protocol string,"
          " packet_size long, duration double, flags array<string>, attack_type string, confidence_score double, severity string, is_malicious boolean")


@pytest.fixture(scope="module")
def chunks(spark, tmp_path_factory):
    """Rows in time order, written as four files that arrive one per micro-batch."""
    rng, folder = random.Random(7), tmp_path_factory.mktemp("chunks")
    times = sorted(rng.randrange(0, 9000) for _ in range(240))
    rows = [(i, BASE + dt.timedelta(seconds=t), rng.choice(["a", "a", "b"]), "x", 1000, 80, "TCP", 100 + i, 0.5, ["SYN"], rng.choice(TYPES),
             0.8, rng.choice(["LOW", "HIGH"]), True) for i, t in enumerate(times)]
    for n in range(4):
        spark.createDataFrame(rows[n * 60:(n + 1) * 60], SCHEMA).coalesce(1).write.mode("append").json(f"{folder}/all")
    return str(folder) + "/all", spark.createDataFrame(rows, SCHEMA)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(path)


def ids(df, column="record_id"):
    return sorted(r[0] for r in df.select(column).collect())


def test_dedup(spark, chunks):
    path, batch = chunks
    got = S.drain(S.dedup_alert_stream(stream(spark, path), 120))
    assert ids(got) == ids(A.dedup_alerts(batch, 120))


def test_correlation(spark, chunks):
    path, batch = chunks
    to_events = lambda df: C.with_stage(df.withColumnRenamed("record_id", "event_id"))
    for rule in (C.CorrelationRule("seq", 1200, 2, 10, ("Probe", "Port Scan", "Brute Force"), same_source=True),
                 C.CorrelationRule("multi", 1500, 3, 6, same_source=True, kill_chain=True, escalating=True),
                 C.CorrelationRule("coord", 600, 3, 8, same_target=True, multiple_sources=True, similar_types=True)):
        got = {r["event_id"]: list(r["matched"]) for r in S.drain(S.correlate_stream(to_events(stream(spark, path)), rule)).collect()}
        want = {r["event_id"]: list(r["matched"]) for r in C.apply_rules(to_events(batch), [rule]).collect()}
        assert got == want and want


def test_correlation_state_is_cut_by_time(spark, chunks, monkeypatch):
    path, batch = chunks
    monkeypatch.setattr(S, "STATE_SLICES", 1)
    to_events = lambda df: C.with_stage(df.withColumnRenamed("record_id", "event_id"))
    for rule in (C.CorrelationRule("seq", 300, 2, 10, ("Probe", "Port Scan"), same_source=True),
                 C.CorrelationRule("coord", 300, 3, 8, same_target=True, multiple_sources=True, similar_types=True)):
        found = S.correlate_stream(to_events(stream(spark, path)), rule)
        assert "_bucket" in found._jdf.queryExecution().analyzed().toString()
        got = {r["event_id"]: list(r["matched"]) for r in S.drain(found).collect()}
        want = {r["event_id"]: list(r["matched"]) for r in C.apply_rules(to_events(batch), [rule]).collect()}
        assert got == want and want


def test_flows_close_with_the_watermark(spark, chunks):
    path, batch = chunks
    got = S.drain(S.flow_stream(stream(spark, path), timeout=60, flow_cols=("source_ip",)))
    want = W.flows(batch, timeout=60, flow_cols=("source_ip",))
    end = batch.agg(F.max("ts")).first()[0]
    closed = want.where(F.unix_seconds("last_time") + 60 < F.unix_seconds(F.lit(end)))
    key = lambda df: sorted((r["flow_key"], r["packet_count"], r["start_time"]) for r in df.collect())
    assert key(got) == key(closed)


def test_profiles_and_stats(spark, chunks):
    path, batch = chunks
    folder = S.work_folder(spark, "t")
    S.profile_stream(stream(spark, path), f"{folder}/p", f"{folder}/c").awaitTermination()
    stored, number = read_generation(spark, f"{folder}/p")
    assert number == 4
    key = lambda df: sorted((r["entity_id"], r["feature"], r["count"], round(r["std"], 6)) for r in df.collect())
    assert key(B.finish(stored)) == key(B.behavior_profiles(batch))
    S.record_stats(stream(spark, path), f"{folder}/s", f"{folder}/sc").awaitTermination()
    assert S.stream_stats(spark, f"{folder}/s").first()["processed"] == 240


def test_actions_and_windows(spark, chunks):
    path, _ = chunks
    seen = []
    S.alert_actions(stream(spark, path), lambda df, n: seen.append((n, df.count())), S.work_folder(spark, "a")).awaitTermination()
    assert seen == [(0, 60), (1, 60), (2, 60), (3, 60)]
    assert S.drain(S.coordinated_stream(stream(spark, path), sources=1, volume=20, delay="1 minute")).count() >= 1
    assert S.drain(S.rates_stream(stream(spark, path))).agg(F.max("request_rate")).first()[0] > 0
    assert S.drain(S.dedup_alert_stream_approximate(stream(spark, path))).count() > 0


def test_messages(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.txt").write_text('{"record_id": 1, "ts": "2024-01-01T00:00:00Z", "source_ip": "a", "flags": ["SYN"]}\nnot json\n')
    got = S.drain(S.parse_messages(spark.readStream.text(str(tmp_path / "m")))).collect()
    assert [(r["record_id"], r["flags"]) for r in got] == [(1, ["SYN"])]


def test_profiles_count_the_batches_of_a_second_checkpoint(spark, chunks, tmp_path):
    path, batch = chunks
    for name in ("one", "two", "two"):  # the last run has nothing new
        S.profile_stream(stream(spark, path), f"{tmp_path}/table", f"{tmp_path}/{name}").awaitTermination()
    stored, _ = read_generation(spark, f"{tmp_path}/table")
    once = {(r["entity_id"], r["feature"]): r["n"] for r in B.profile_parts(B.observations(batch)).withColumnRenamed("count", "n").collect()}
    twice = {(r["entity_id"], r["feature"]): r["n"] for r in stored.withColumnRenamed("count", "n").collect()}
    assert twice == {k: 2 * n for k, n in once.items()}


def test_coordinated_hours_are_exact(spark, tmp_path):
    rows = [(i, BASE + dt.timedelta(minutes=i % 60 + 60 * (i // 60)), f"s{i % 7}") for i in range(300)]
    spark.createDataFrame(rows, "record_id long, ts timestamp, source_ip string").coalesce(1).write.json(f"{tmp_path}/in")
    source = spark.readStream.schema("record_id long, ts timestamp, source_ip string").json(f"{tmp_path}/in")
    got = S.drain(S.coordinated_stream(source)).collect()
    assert {(r["sources"], r["events"]) for r in got} == {(7, 60)} and len(got) >= 3


def plain_alerts(rows, min_obs):
    """(record, feature) -> z of every value against all values before it."""
    past, out = {}, {}
    for record, entity, feature, value in rows:
        seen = past.setdefault((entity, feature), [])
        if len(seen) >= min_obs and max(seen) > min(seen):
            z = abs(value - statistics.mean(seen)) / statistics.stdev(seen)
            if z > 2:
                out[record, feature] = round(z, 6)
        seen.append(value)
    return out


def test_record_alerts_see_stored_batches_and_earlier_records(spark, chunks, tmp_path):
    path, batch = chunks
    S.profile_stream(stream(spark, path), f"{tmp_path}/p", f"{tmp_path}/c", alerts=f"{tmp_path}/a", min_obs=8).awaitTermination()
    rows = [(r["record_id"], r["entity_id"], r["feature"], r["value"])
            for r in B.observations(batch).orderBy("ts", "record_id", "feature").collect()]
    want = plain_alerts(rows, 8)
    got = {(r["record_id"], r["feature"]): round(r["z_score"], 6) for r in S.stored_alerts(spark, f"{tmp_path}/a").collect()}
    assert got == want and len(want) > 3


def test_record_alerts_of_one_busy_entity_with_gaps(spark):
    rng = random.Random(3)
    rows = [(i, BASE + dt.timedelta(seconds=i // 3), "hot", "size", None if i % 11 == 0 else rng.gauss(5, 1)) for i in range(600)]
    obs = spark.createDataFrame(rows, "record_id long, ts timestamp, entity_id string, feature string, value double")
    got = {(r["record_id"], r["feature"]): round(r["z_score"], 6) for r in B.record_alerts(obs, min_obs=10, bucket_seconds=7).collect()}
    want = plain_alerts([(i, e, f, v) for i, _, e, f, v in rows if v is not None], 10)
    assert got == want and len(want) > 10
    assert B.record_alerts(obs.limit(0)).count() == 0
    level = obs.withColumn("value", F.lit(0.1))  # equal values have no spread, whatever rounding leaves
    assert B.record_alerts(level, min_obs=10).count() == 0
