"""Rule families at the borders of their comparisons, then scores, verdicts and order."""

import json

import pytest
from pyspark.sql import functions as F

from tarnwatch.operators import signatures as S

COLUMNS = ("record_id long, source_ip string, destination_ip string, source_port int, destination_port int, protocol string, "
           "packet_size int, duration double, features map<string,double>")


@pytest.fixture
def flow(spark):
    """A packet between documentation addresses, with what a case changes."""
    def make(size=640, seconds=2.25, ports=(40200, 8443), protocol="UDP", hosts=("198.51.100.23", "203.0.113.9"), features=None):
        return spark.createDataFrame([(7, *hosts, *ports, protocol, size, seconds, {"ttl": 61.5} if features is None else features)], COLUMNS)

    return make


def matches(df, family, pattern, listed=False):
    text = pattern if isinstance(pattern, str) else json.dumps(pattern)
    return df.select(S.rule_predicate(S.SignatureRule("id", "name", "LOW", family, text), F.lit(listed))).first()[0]


@pytest.mark.parametrize("ports, wanted", [((8443, 1), True), ((1, 8443), True), ((8442, 8444), False)])
def test_a_port_in_the_text_decides(flow, ports, wanted):
    assert matches(flow(ports=ports), "suricata", "alert udp $LAB any -> $NET :8443 (classtype:demo;)") is wanted


def test_protocol_comes_before_listed_hosts(flow):
    rule = "alert tcp $LAB any -> $NET :9 (classtype:demo;)"
    assert matches(flow(protocol="tcp"), "suricata", rule, listed=True) is True
    assert matches(flow(protocol="udp"), "suricata", rule, listed=True) is False


@pytest.mark.parametrize("protocol, features, wanted", [("ICMP", {"ttl": 61.5}, True), ("ICMP", {"hops": 2.0}, False), ("ICMP", {}, False)])
def test_contents_are_looked_up_in_the_features(flow, protocol, features, wanted):
    assert matches(flow(protocol=protocol, features=features), "suricata", 'alert icmp $LAB any -> $NET any (content:"TTL: 61";)') is wanted


@pytest.mark.parametrize("text, change, wanted", [
    ("alert udp any any -> any any (rev:2;)", {"size": 10_001}, True),
    ("alert udp any any -> any any (rev:2;)", {"size": 10_000}, False),
    ("alert udp any any -> any any (rev:2;)", {"ports": (1023, 1023)}, True),
    ("alert udp any any -> any any (rev:2;)", {"ports": (1023, 1024)}, False),
    ('alert udp $LAB any (msg:"a DOSe of packets";)', {"size": 5_001}, True),
    ('alert udp $LAB any (msg:"a DOSe of packets";)', {"size": 5_000}, False),
    ('alert udp $LAB any (msg:"someone Scans";)', {"seconds": 0.0099}, True),
    ('alert udp $LAB any (msg:"someone Scans";)', {"seconds": 0.01}, False),
    ("alert tcp any any -> any any (rev:2;)", {"size": 60_000}, False),
    ("alert udp $LAB any (rev:2;)", {"size": 60_000}, False),
])
def test_snort_borders(flow, text, change, wanted):
    assert matches(flow(**change), "snort", text) is wanted


@pytest.mark.parametrize("text, wanted", [
    ('rule one { strings: $h = "198.51.100.23:40200->" condition: $h }', True),
    ('rule two { strings: $h = "198.51.100.24" $i = "113.9:8443" condition: any of them }', True),
    ('rule none { strings: $h = "192.0.2.1" condition: $h }', False),
    ("rule over { condition: filesize > 639 }", True),
    ("rule over { condition: filesize > 640 }", False),
    ("rule under { condition: filesize < 641 }", True),
    ("rule under { condition: filesize < 640 }", False),
])
def test_yara_strings_and_sizes(flow, text, wanted):
    assert matches(flow(), "yara", text) is wanted


@pytest.mark.parametrize("wanted, result", [
    ({"source_ip": "198.51.100.16/28"}, True),
    ({"source_ip": "198.51.100.32/28"}, False),
    ({"destination_ip": ["192.0.2.1", "203.0.113.9"]}, True),
    ({"destination_ip": []}, False),
    ({"source_port": {"min": 40200, "max": 40200}}, True),
    ({"source_port": {"min": 40201}}, False),
    ({"destination_port": [1, 8443], "protocol": "Udp"}, True),
    ({"destination_port": True}, False),
    ({"packet_size": {"max": 639}}, False),
    ({"features": {"ttl": 61.5009}}, True),
    ({"features": {"ttl": 61.502}}, False),
    ({"features": {"ttl": {"min": 61, "max": 62, "equals": 61.4995}}}, True),
    ({"features": {"unknown": 1}}, True),
    ({}, True),
])
def test_custom_conditions(flow, wanted, result):
    assert matches(flow(), "custom", wanted) is result


def test_custom_text_that_is_no_json(flow):
    assert matches(flow(), "custom", "{broken") is False


def scored(df, malicious, confidence):
    return df.withColumns({"is_malicious": F.lit(malicious), "confidence_score": F.lit(confidence), "attack_type": F.lit("Probe"),
                           "ts": F.lit("2024-03-01").cast("timestamp")})


RULES = [S.SignatureRule("q", "small", "MEDIUM", "yara", "rule q { condition: filesize < 700 }"),
         S.SignatureRule("p", "datagram", "LOW", "custom", '{"protocol": "udp"}'),
         S.SignatureRule("o", "switched off", "CRITICAL", "custom", "{}", enabled=False),
         S.SignatureRule("z", "flood", "HIGH", "suricata", "alert udp $LAB any -> $NET any (classtype:demo;)")]


def test_families_are_ordered_and_weighted(flow):
    row = S.detect(scored(flow(), True, 0.6), RULES).first()
    assert [m["rule_id"] for m in row["rule_matches"]] == ["z", "q", "p"]
    assert row["signature_score"] == pytest.approx((0.8 + 0.5 + 0.2) / 3)
    assert row["combined_score"] == pytest.approx(0.7 * 0.6 + 0.3 * 0.5)
    assert (row["verdict"], row["threat_level"]) == ("SUSPICIOUS", "LOW")
    alert = S.detection_alerts(S.detect(scored(flow(), True, 0.6), RULES)).first()
    assert alert["description"].endswith("flood, small, datagram") and "0.60" in alert["description"]


def test_a_critical_rule_decides_alone(flow):
    row = S.detect(scored(flow(), False, 0.99), [S.SignatureRule("k", "k", "CRITICAL", "custom", "{}")]).first()
    assert (row["verdict"], row["threat_level"]) == ("MALICIOUS", "CRITICAL")


def test_rules_beyond_one_chunk(flow, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 2)
    rules = [S.SignatureRule(f"size{i}", "n", "LOW", "yara", f"rule s {{ condition: filesize > {i * 160} }}") for i in range(7)]
    assert [r["rule_id"] for r in S.signature_matches(flow(), rules).orderBy("ord").collect()] == ["size0", "size1", "size2", "size3"]


def test_indicators_listed_twice_count_once(spark, flow):
    listed = spark.createDataFrame([("203.0.113.9", "ip")] * 2, "indicator string, indicator_type string")
    assert S.indicator_hits(flow(), listed).count() == 1
    assert S.indicator_hits(flow(), listed, clean=True).count() == 0
