"""Signature rules compiled to column predicates, scoring and hybrid verdicts.

A rule table is configuration: its patterns are parsed once on the driver and
become part of the projection, so matching needs neither a join nor a shuffle.
Rule sets larger than ``CHUNK`` rules are evaluated in several projections.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions import net
from tarnwatch.functions.columns import all_of, any_of, cases, col, count_if, lookup
from tarnwatch.functions.text import md5_id
from tarnwatch.session import config_rows

FAMILIES = ["suricata", "snort", "yara", "custom"]
CHUNK = 200


@dataclass(frozen=True)
class SignatureRule:
    rule_id: str
    name: str
    severity: str
    rule_type: str
    pattern: str
    description: str = ""
    metadata: dict = field(default_factory=dict)
    enabled: bool = True


def rules_from_table(df: DataFrame) -> list[SignatureRule]:
    """Rule rows (as the rule reader produces them) as rule objects, in table order."""
    return [SignatureRule(r["rule_id"], r["name"], r["severity"], r["rule_type"], r["pattern"],
                          enabled=r["enabled"]) for r in config_rows(df, "the rule table")]


# --- elementary conditions -----------------------------------------------------

def port_condition(port, condition) -> Column:
    """int, list of ints, or {min, max}."""
    if isinstance(condition, bool) or condition is None:
        return F.lit(False)
    if isinstance(condition, int):
        return col(port) == condition
    if isinstance(condition, list):
        return col(port).isin(*condition) if condition else F.lit(False)
    if isinstance(condition, dict):
        return _bounds(col(port), condition)
    return F.lit(False)


def _bounds(value: Column, condition: dict) -> Column:
    parts = []
    if "min" in condition:
        parts.append(value >= condition["min"])
    if "max" in condition:
        parts.append(value <= condition["max"])
    return all_of(parts)


def feature_condition(value, condition) -> Column:
    """number within 0.001, or {min, max, equals}."""
    v = col(value)
    if isinstance(condition, (int, float)) and not isinstance(condition, bool):
        return F.abs(v - condition) < 0.001
    if isinstance(condition, dict):
        parts = [_bounds(v, condition)]
        if "equals" in condition:
            parts.append(F.abs(v - condition["equals"]) < 0.001)
        return all_of(parts)
    return F.lit(False)


def ip_condition(ip, condition) -> Column:
    if isinstance(condition, str):
        return net.ip_in_network(ip, condition)
    if isinstance(condition, list):
        return F.coalesce(col(ip).isin(*condition), F.lit(False)) if condition else F.lit(False)
    return F.lit(False)


# --- rule families --------------------------------------------------------------

def _gate(pattern: str, anywhere: bool) -> str | None:
    text = pattern.lower() if anywhere else pattern
    found = (lambda p: p in text) if anywhere else text.startswith
    return next((p for p in ("tcp", "udp") if found(f"alert {p}")), None)


def _feature_text() -> Column:
    """Lower-cased ``name: value`` text of the open feature map."""
    return F.lower(F.array_join(F.transform(
        F.map_entries("features"),
        lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string"))), ", "))


def suricata(pattern: str, bad_ip: Column) -> Column:
    """Protocol gate, then a bad IP always matches, then port, then content, then bare protocol."""
    gate = _gate(pattern, anywhere=True)
    protocol = F.lower("protocol") == gate if gate else F.lit(True)
    port = re.search(r":(\d+)", pattern)
    if port:
        number = int(port.group(1))
        specific = (F.col("source_port") == number) | (F.col("destination_port") == number)
    else:
        contents = [_feature_text().contains(c.lower()) for c in re.findall(r'content:"([^"]+)"', pattern)]
        specific = any_of([F.coalesce(c, F.lit(False)) for c in contents]) | F.lit(gate is not None)
    return protocol & (bad_ip | specific)


def snort(pattern: str) -> Column:
    gate = _gate(pattern, anywhere=False)
    protocol = F.lower("protocol") == gate if gate else F.lit(True)
    options = []
    if "any -> any" in pattern:
        options += [F.col("packet_size") > 10000,
                    (F.col("source_port") < 1024) & (F.col("destination_port") < 1024)]
    message = re.search(r'msg:"([^"]+)"', pattern)
    if message:
        text = message.group(1).lower()
        if "dos" in text:
            options.append(F.col("packet_size") > 5000)
        if "scan" in text:
            options.append(F.col("duration") < 0.01)
    return protocol & any_of(options)


def yara(pattern: str) -> Column:
    options = []
    if "strings:" in pattern:
        section = pattern.partition("strings:")[2].partition("condition:")[0]
        line = F.lower(F.concat("source_ip", F.lit(":"), F.col("source_port").cast("string"), F.lit("->"),
                                "destination_ip", F.lit(":"), F.col("destination_port").cast("string")))
        options += [line.contains(s.lower()) for s in re.findall(r'\$\w+\s*=\s*"([^"]+)"', section)]
    condition = pattern.partition("condition:")[2]
    size = re.search(r"filesize\s*[<>]=?\s*(\d+)", condition)
    if size:
        limit = int(size.group(1))
        if "<" in condition:
            options.append(F.col("packet_size") < limit)
        if ">" in condition:
            options.append(F.col("packet_size") > limit)
    return any_of(options)


def custom(pattern: str) -> Column:
    """Conjunction of the conditions present in a JSON object; bad JSON matches nothing."""
    try:
        wanted = json.loads(pattern)
    except ValueError:
        return F.lit(False)
    parts = []
    for name in ("source_ip", "destination_ip"):
        if name in wanted:
            parts.append(ip_condition(name, wanted[name]))
    for name in ("source_port", "destination_port"):
        if name in wanted:
            parts.append(port_condition(name, wanted[name]))
    if "protocol" in wanted:
        parts.append(F.lower("protocol") == wanted["protocol"].lower())
    if isinstance(wanted.get("packet_size"), dict):
        parts.append(_bounds(F.col("packet_size"), wanted["packet_size"]))
    for name, condition in wanted.get("features", {}).items():
        value = F.try_element_at(F.col("features"), F.lit(name))
        parts.append(value.isNull() | feature_condition(value, condition))
    return all_of(parts)


def rule_predicate(rule: SignatureRule, bad_ip: Column) -> Column:
    if rule.rule_type == "suricata":
        return suricata(rule.pattern, bad_ip)
    return {"snort": snort, "yara": yara, "custom": custom}[rule.rule_type](rule.pattern)


# --- matching ------------------------------------------------------------------

def mark_bad_ips(df: DataFrame, indicators: DataFrame | None) -> DataFrame:
    """Add ``bad_ip``: source or destination is a known indicator (two equi-joins on distinct IPs)."""
    if indicators is None:
        return df.withColumn("bad_ip", F.lit(False))
    bad = indicators.where("indicator_type = 'ip'").select("indicator").distinct()
    src = bad.select(F.col("indicator").alias("source_ip"), F.lit(True).alias("_src_bad"))
    dst = bad.select(F.col("indicator").alias("destination_ip"), F.lit(True).alias("_dst_bad"))
    return (df.join(src, "source_ip", "left").join(dst, "destination_ip", "left")
            .withColumn("bad_ip", F.coalesce("_src_bad", "_dst_bad", F.lit(False)))
            .drop("_src_bad", "_dst_bad"))


def with_matches(df: DataFrame, rules: list[SignatureRule], indicators: DataFrame | None = None) -> DataFrame:
    """Add ``rule_matches``: matching rules, families in order, rules in table order."""
    ordered = sorted((r for r in rules if r.enabled and r.rule_type in FAMILIES),
                     key=lambda r: FAMILIES.index(r.rule_type))
    marked = mark_bad_ips(df, indicators)
    empty = F.expr("CAST(array() AS array<struct<ord:int,rule_id:string,name:string,severity:string,family:string>>)")
    out = marked.withColumn("rule_matches", empty)
    for start in range(0, len(ordered), CHUNK):
        found = [F.when(rule_predicate(r, F.col("bad_ip")), F.struct(
            F.lit(start + i).alias("ord"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.name).alias("name"),
            F.lit(r.severity).alias("severity"), F.lit(r.rule_type).alias("family")))
            for i, r in enumerate(ordered[start:start + CHUNK])]
        out = out.withColumn("rule_matches", F.concat("rule_matches", F.array_compact(F.array(*found))))
    return out


def signature_matches(df: DataFrame, rules: list[SignatureRule], indicators: DataFrame | None = None,
                      family: str | None = None) -> DataFrame:
    """One row per (record, matching rule)."""
    chosen = [r for r in rules if family in (None, r.rule_type)]
    return with_matches(df, chosen, indicators).select(
        "record_id", F.explode("rule_matches").alias("m")).select("record_id", "m.*")


def score_column() -> Column:
    """Mean severity weight of the matches, 0 without matches."""
    weights = F.transform("rule_matches", lambda m: lookup(m["severity"], K.SEVERITY_WEIGHTS,
                                                          K.DEFAULT_SEVERITY_WEIGHT))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size("rule_matches") > 0, total / F.size("rule_matches")).otherwise(0.0)


def hybrid_verdict(matched: DataFrame, ml_weight: float = 0.7, sig_weight: float = 0.3,
                   threshold: float = 0.5) -> DataFrame:
    """Combine model confidence and signature score; a CRITICAL rule overrides the verdict.

    Expects ``rule_matches`` and prediction columns; a NULL ``is_malicious`` means no prediction.
    """
    ml = cases([(F.col("is_malicious").isNull(), F.lit(0.0)),
                (F.col("is_malicious"), F.col("confidence_score"))], 1.0 - F.col("confidence_score"))
    score = F.col("combined_score")
    critical = F.exists("rule_matches", lambda m: m["severity"] == "CRITICAL")
    # fixed values: limits, verdicts and actions
    malicious, suspicious, mild = score >= 0.8, score >= 0.6, score >= threshold
    return (matched.withColumn("signature_score", score_column())
            .withColumn("combined_score", ml * ml_weight + F.col("signature_score") * sig_weight)
            .withColumns({
                "verdict": cases([(critical | malicious, "MALICIOUS"), (suspicious | mild, "SUSPICIOUS")], "BENIGN"),
                "threat_level": cases([(critical | (score >= 0.9), "CRITICAL"), (malicious, "HIGH"),
                                       (suspicious, "MEDIUM")], "LOW"),
                "detection_action": cases([
                    (critical | malicious, "Block immediately"), (suspicious, "Investigate and monitor"),
                    (mild, "Monitor closely")], "Allow")}))


def detect(df: DataFrame, rules: list[SignatureRule], indicators: DataFrame | None = None, **weights) -> DataFrame:
    return hybrid_verdict(with_matches(df, rules, indicators), **weights)


def detection_alerts(detected: DataFrame) -> DataFrame:
    """Alert rows for detections that are not benign."""
    # fixed values: texts
    ml_part = F.when(F.col("is_malicious"), F.format_string(
        "ML detected %s (confidence: %.2f)", F.coalesce("attack_type", F.lit("Unknown")), F.col("confidence_score")))
    names = F.array_join(F.transform(F.slice("rule_matches", 1, 3), lambda m: m["name"]), ", ")
    sig_part = F.when(F.size("rule_matches") > 0, F.concat(F.lit("Signature matches: "), names))
    parts = F.concat_ws("; ", ml_part, sig_part)
    attack = F.when(F.col("is_malicious").isNull(), "Signature-based").otherwise(
        F.coalesce("attack_type", F.lit("Unknown")))
    return detected.where("verdict <> 'BENIGN'").select(
        md5_id(["source_ip", "destination_ip", "ts"], 16).alias("alert_id"), "record_id", "ts",
        F.col("threat_level").alias("severity"), attack.alias("attack_type"), "source_ip", "destination_ip",
        F.col("combined_score").alias("confidence_score"),
        F.when(parts == "", "Hybrid detection triggered").otherwise(parts).alias("description"),
        F.col("detection_action").alias("recommended_action"))


def _of_family(family: str):
    return lambda m: m["family"] == family


def detection_stats(detected: DataFrame, rules: list[SignatureRule], indicator_count: int = 0) -> DataFrame:
    """(section, item, n): detections by source, matches by family, rule and indicator counts."""
    has_rules = F.size("rule_matches") > 0
    named = {
        ("detections", "total"): F.count("*"),
        ("detections", "ml"): count_if(F.col("is_malicious")),
        ("detections", "signature"): count_if(has_rules),
        ("detections", "hybrid"): count_if(has_rules & F.col("is_malicious").isNotNull()),
        **{("matches", f): F.sum(F.size(F.filter("rule_matches", _of_family(f)))) for f in FAMILIES},
    }
    totals = detected.agg(*[agg.cast("long").alias(f"{a}:{b}") for (a, b), agg in named.items()])
    fixed = {("rules", f): sum(r.rule_type == f for r in rules) for f in FAMILIES}
    fixed[("rules", "total")] = sum(fixed.values())
    fixed[("indicators", "ip")] = indicator_count
    entries = [F.struct(F.lit(a).alias("section"), F.lit(b).alias("item"), F.col(f"`{a}:{b}`").alias("n"))
               for a, b in named]
    entries += [F.struct(F.lit(a).alias("section"), F.lit(b).alias("item"), F.lit(n).cast("long").alias("n"))
                for (a, b), n in fixed.items()]
    return totals.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def indicator_hits(df: DataFrame, indicators: DataFrame, clean: bool = False) -> DataFrame:
    """Traffic touching a known bad IP, or (``clean``) traffic touching none."""
    marked = mark_bad_ips(df, indicators)
    return marked.where(~F.col("bad_ip") if clean else F.col("bad_ip")).drop("bad_ip")
