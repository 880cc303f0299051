"""Flow sessions and packet features against plain Python."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions import net
from tarnwatch.operators import features as X
from tarnwatch.operators import flows as W

BASE = dt.datetime(2024, 1, 1)
SCHEMA = ("record_id long, ts timestamp, source_ip string, destination_ip string, source_port int, destination_port int, "
          "protocol string, packet_size int, duration double, flags array<string>")


def packets(spark, rows):
    """rows: (seconds, source, size)"""
    return spark.createDataFrame(
        [(i, BASE + dt.timedelta(seconds=t), s, "10.0.0.1", 40000, 80, "TCP", size, 0.5, ["SYN", "ack"] if i % 2 else ["SYN"])
         for i, (t, s, size) in enumerate(rows)], SCHEMA)


def naive(rows, timeout=300):
    out, state = {}, {}
    for i, (t, s, size) in sorted(enumerate(rows), key=lambda x: (x[1][0], x[0])):
        f = state.get(s)
        if f is None or t - f["last"] > timeout:
            f = state[s] = {"start": t, "last": None, "sizes": [], "gaps": []}
        if f["last"] is not None:
            f["gaps"].append(t - f["last"])
        f["last"] = t
        f["sizes"].append(size)
        out[i] = (t - f["start"], list(f["sizes"]), list(f["gaps"]))
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_sessions_match_loop(spark, seed, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_ROWS", 20)
    rng = random.Random(seed)
    rows = [(rng.randrange(0, 40000), "hot", rng.randrange(40, 1500)) for _ in range(300)]
    rows += [(rng.randrange(0, 40000), rng.choice("bc"), 100) for _ in range(60)]
    want = naive(rows)
    df = W.recent_flow_stats(W.running_flow_features(packets(spark, rows)).select(*packets(spark, rows).columns), n=5)
    run = {r["record_id"]: r for r in W.running_flow_features(packets(spark, rows)).collect()}
    stat = {r["record_id"]: r for r in df.collect()}
    assert len(run) == len(stat) == len(rows)
    for i, (duration, sizes, gaps) in want.items():
        r, s = run[i], stat[i]
        assert r["flow_duration"] == pytest.approx(duration)
        assert r["flow_packet_count"] == len(sizes) and r["flow_bytes_total"] == sum(sizes)
        assert r["flow_bytes_per_second"] == pytest.approx(sum(sizes) / max(duration, 0.001))
        assert s["packet_size_mean"] == pytest.approx(statistics.fmean(sizes[-5:]))
        assert s["packet_size_std"] == pytest.approx(statistics.pstdev(sizes[-5:]), abs=1e-9)
        last = gaps[-5:] if len(sizes) > 5 else gaps
        last = gaps[-5:]
        if len(sizes) <= 5:
            assert s["inter_arrival_max"] == (max(last) if last else 0)


def test_flow_rows_and_gap_border(spark):
    df = packets(spark, [(0, "a", 10), (300, "a", 20), (601, "a", 30), (50_000, "a", 5)])
    got = sorted((r["packet_count"], r["total_bytes"], r["duration"], tuple(r["flags"])) for r in W.flows(df).collect())
    assert got == [(1, 5, 0.0, ("SYN", "ack")), (1, 30, 0.0, ("SYN",)), (2, 30, 300.0, ("SYN", "ack"))]


def test_flow_key_ignores_direction(spark):
    df = spark.createDataFrame([("10.0.0.2", "10.0.0.1", 80, 5000, "TCP"), ("10.0.0.1", "10.0.0.2", 5000, 80, "TCP")],
                               "source_ip string, destination_ip string, source_port int, destination_port int, protocol string")
    assert {r[0] for r in df.select(net.flow_key()).collect()} == {"10.0.0.1:80-10.0.0.2:5000-TCP"}


def test_full_feature_vector(spark):
    rows = [(i * 7, "ab"[i % 2], 100 + i) for i in range(150)]
    out = W.traffic_features(packets(spark, rows))
    assert out.columns == ["record_id", *K.FEATURE_NAMES]
    got = {r["record_id"]: r for r in out.collect()}
    assert got[0]["protocol_frequency"] == 1.0
    # 150 packets share one destination port; beyond the first hundred the divisor stays 100
    assert got[149]["port_frequency_dst"] == pytest.approx(1.5)
    assert got[49]["port_frequency_dst"] == 1.0
    assert got[3]["flag_syn"] == 1.0 and got[3]["flag_ack"] == 1.0 and got[2]["flag_ack"] == 0.0


def test_record_features(spark):
    df = packets(spark, [(3600 * 5, "2001:db8::1", 60)])
    r = X.time_features(X.port_features(X.basic_features(df))).first()
    assert (r["hour_of_day"], r["day_of_week"], r["src_port_category"], r["dst_port_category"]) == (5.0, 0.0, 2.0, 1.0)
    assert X.filter_traffic(df, ipv6=False).count() == 0 and X.filter_traffic(df, predicate="packet_size > 50").count() == 1
    assert X.filter_traffic(df, protocols=("UDP",)).count() == 0


def test_addresses(spark):
    values = [("192.168.1.1", True), ("256.1.1.1", False), ("::1", True), ("2001:db8::1", True), ("2001:::1", False), ("x", False)]
    df = spark.createDataFrame(values, "ip string, ok boolean")
    assert df.where(net.is_valid_ip("ip") != F.col("ok")).count() == 0
    nets = spark.createDataFrame([("2001:db8::7",)], "ip string")
    assert nets.select(net.ip_in_network("ip", "2001:db8::/32"), net.ip_in_network("ip", "2001:db9::/32")).first()[:] == (True, False)
    domains = spark.createDataFrame([("a-b.example.com", True), ("-a.com", False), ("a..b", False), ("a" * 64 + ".com", False)],
                                    "d string, ok boolean")
    assert domains.where(net.is_valid_domain("d") != F.col("ok")).count() == 0


def test_tcp_flags_and_lengths(spark):
    df = spark.createDataFrame([(0x12, 5, 100), (0, None, 100)], "flag_bits int, ihl int, packet_size int")
    rows = X.length_features(X.tcp_flags(df)).collect()
    assert rows[0]["tcp_flags"] == ["SYN", "ACK"] and (rows[0]["header_length"], rows[0]["payload_length"]) == (20, 80)
    assert rows[1]["tcp_flags"] == [] and rows[1]["header_length"] == 40


def test_align_features(spark):
    df = spark.createDataFrame([(1, 5.0)], "record_id long, packet_size double")
    r = W.align_features(df, scaling={"packet_size": (1.0, 2.0)}).first()
    assert r["packet_size"] == 2.0 and r["duration"] == 0.0 and len(r) == 30
