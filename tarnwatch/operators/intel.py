"""Threat intelligence: feeds, reputation, geolocation and threat patterns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions import net
from tarnwatch.functions.columns import count_if, lookup, seconds
from tarnwatch.sources.tables import latest_rows

GEO_PREFIX_BITS = 16


def parse_feed(lines: DataFrame, kind: str, source: str, value: str = "value", ipv6: bool = True) -> DataFrame:
    """Feed lines to indicator rows: comments dropped, invalid entries dropped."""
    entry = F.trim(F.col(value))
    valid = {"ip": lambda: net.is_valid_ip("indicator", ipv6), "domain": lambda: net.is_valid_domain("indicator")}[kind]()
    return (lines.select(entry.alias("indicator"))
            .where((F.length("indicator") > 0) & ~F.col("indicator").rlike("^[#;]")).where(valid)
            .select("indicator", F.lit(kind).alias("indicator_type"),
                    F.lit(K.FEED_THREAT_TYPES.get(source, "unknown")).alias("threat_type"),
                    F.lit(K.FEED_CONFIDENCE).alias("confidence"), F.lit(source).alias("source")))


def upsert_indicators(current: DataFrame, incoming: DataFrame, version: str = "last_seen") -> DataFrame:
    """Newest row per (indicator, source); incoming wins ties."""
    return latest_rows([current, incoming], ["indicator", "source"], version)


def feeds_due(feeds: DataFrame, log: DataFrame, now: datetime, interval_seconds: int) -> DataFrame:
    """Feeds that were never loaded or whose last load is older than the interval."""
    latest = log.groupBy("feed_name").agg(F.max("last_update").alias("last_update"),
                                          F.max_by("status", "last_update").alias("status"))
    age = F.unix_seconds(F.lit(now)) - F.unix_seconds("last_update")
    return feeds.join(latest, "feed_name", "left").where(
        F.col("last_update").isNull() | (age >= interval_seconds))


def ip_reputation(ips: DataFrame, indicators: DataFrame, geo: DataFrame | None = None) -> DataFrame:
    """Reputation per distinct address: mean confidence (at most 1), threat types, sources."""
    known = (indicators.where("indicator_type = 'ip'").groupBy(F.col("indicator").alias("ip"))
             .agg(F.least(F.avg("confidence"), F.lit(1.0)).alias("score"),
                  F.array_sort(F.collect_set("threat_type")).alias("types"),
                  F.array_sort(F.collect_set("source")).alias("srcs")))
    none = F.expr("CAST(array() AS array<string>)")
    out = ips.select("ip").distinct().join(known, "ip", "left").select(
        "ip", F.coalesce("score", F.lit(0.0)).alias("reputation_score"),
        F.coalesce("types", none).alias("threat_types"), F.coalesce("srcs", none).alias("sources"),
        F.coalesce(F.array_contains("types", "tor"), F.lit(False)).alias("is_tor"))
    return out if geo is None else geolocate(out, geo, "ip")


def geolocate(df: DataFrame, ranges: DataFrame, ip: str, attributes=("country",)) -> DataFrame:
    """Attach the attributes of the IPv4 range an address falls in (NULL when none).

    Distinct addresses are located once. Ranges are cut at /16 borders so the
    match is an equi-join on the prefix plus a bound check; overlapping ranges
    resolve to the narrowest, then the lowest start.
    """
    size = 1 << GEO_PREFIX_BITS
    prefix = F.explode(F.sequence(F.floor(F.col("range_start") / size), F.floor(F.col("range_end") / size)))
    cut = ranges.select("range_start", "range_end", *attributes, prefix.alias("_p"))
    known = (df.select(F.col(ip).alias("_ip")).distinct().withColumn("_n", net.ipv4_to_long("_ip"))
             .where("_n IS NOT NULL").withColumn("_p", F.floor(F.col("_n") / size)))
    rank = F.struct((F.col("range_end") - F.col("range_start")).alias("w"), F.col("range_start").alias("s"))
    located = (known.join(cut, "_p").where(F.col("_n").between(F.col("range_start"), F.col("range_end")))
               .groupBy("_ip").agg(F.min_by(F.struct(*attributes), rank).alias("_g")))
    joined = df.join(located, F.col(ip) == F.col("_ip"), "left")
    return joined.select(*[F.col(c) for c in df.columns], *[F.col(f"_g.{a}").alias(a) for a in attributes])


# --- threat patterns -------------------------------------------------------------

_PATTERN = ["pattern_type", "subject", "confidence", "first_detected", "last_detected", "occurrence_count",
            "description"]


def recon_exploit_patterns(events: DataFrame, min_events: int = 3) -> DataFrame:
    """Sources that scanned and also attacked; the evidence is a set of types, order is not required."""
    grouped = events.groupBy("source_ip").agg(
        F.count("*").alias("c"), F.max(F.col("attack_type") == "scanner").alias("scan"),
        F.max(F.col("attack_type").isin("dos", "exploit")).alias("hit"),
        F.min("ts").alias("first_detected"), F.max("ts").alias("last_detected"))
    return grouped.where((F.col("c") >= min_events) & F.col("scan") & F.col("hit")).select(
        F.lit("attack_sequence").alias("pattern_type"), F.col("source_ip").alias("subject"),
        F.lit(0.8).alias("confidence"), "first_detected", "last_detected",
        F.lit(1).cast("long").alias("occurrence_count"),
        F.concat(F.lit("Reconnaissance followed by exploitation from "), "source_ip").alias("description"))


def recon_exploit_indicators(events: DataFrame, min_events: int = 3) -> DataFrame:
    """Evidence rows of the pattern above in time order: position 0 is the address, then one type per event.

    Kept in long form: a busy source would not fit one array.
    """
    hit = recon_exploit_patterns(events, min_events).select(F.col("subject").alias("source_ip"))
    types = events.join(hit, "source_ip", "left_semi").select(
        "source_ip", "ts", F.col("record_id").alias("event_id"), F.col("attack_type").alias("indicator"))
    address = hit.select("source_ip", F.lit(None).cast("timestamp").alias("ts"),
                         F.lit(None).cast("long").alias("event_id"), F.col("source_ip").alias("indicator"))
    return address.unionByName(types)


def high_frequency_patterns(events: DataFrame, more_than: int = 10, within_seconds: int = 3600,
                            min_events: int = 3) -> DataFrame:
    grouped = events.groupBy("source_ip").agg(
        F.count("*").alias("occurrence_count"), F.min("ts").alias("first_detected"),
        F.max("ts").alias("last_detected"))
    span = seconds("last_detected") - seconds("first_detected")
    return grouped.where((F.col("occurrence_count") > more_than) & (F.col("occurrence_count") >= min_events)
                         & (span < within_seconds)).select(
        F.lit("behavioral").alias("pattern_type"), F.col("source_ip").alias("subject"),
        F.lit(0.7).alias("confidence"), "first_detected", "last_detected", "occurrence_count",
        F.concat(F.lit("High-frequency attacks from "), "source_ip").alias("description"))


def coordinated_patterns(events: DataFrame, sources: int = 5, volume: int = 20) -> DataFrame:
    """Hours with many sources and many events.

    Pre-aggregated per (hour, source), so a busy hour is not gathered in one task.
    """
    per_source = events.groupBy(F.date_trunc("hour", "ts").alias("h"), "source_ip").agg(F.count("*").alias("c"))
    grouped = per_source.groupBy("h").agg(F.count("source_ip").alias("ips"), F.sum("c").alias("n"))
    return grouped.where((F.col("ips") > sources) & (F.col("n") > volume)).select(
        F.lit("temporal").alias("pattern_type"), F.date_format("h", "yyyy-MM-dd HH").alias("subject"),
        F.lit(0.9).alias("confidence"), F.col("h").alias("first_detected"),
        (F.col("h") + F.expr("INTERVAL 1 HOUR")).alias("last_detected"),
        F.col("n").alias("occurrence_count"),
        F.format_string("Coordinated attack from %d IPs", "ips").alias("description"))


def threat_patterns(events: DataFrame, min_events: int = 3) -> DataFrame:
    parts = [recon_exploit_patterns(events, min_events), high_frequency_patterns(events, min_events=min_events),
             coordinated_patterns(events)]
    out = parts[0].select(*_PATTERN)
    for p in parts[1:]:
        out = out.unionByName(p.select(*_PATTERN))
    return out


def threat_summary(indicators: DataFrame, patterns: DataFrame, feed_log: DataFrame) -> DataFrame:
    """(section, item, n, at): indicators by type, threat types, patterns, feed status with load time."""
    none = F.lit(None).cast("timestamp").alias("at")
    counts = (indicators.groupBy("indicator_type", "threat_type").agg(F.count("*").alias("c"))
              .select(F.explode(F.array(
                  F.struct(F.lit("indicator_type").alias("section"), F.col("indicator_type").alias("item"), "c"),
                  F.struct(F.lit("threat_type").alias("section"), F.col("threat_type").alias("item"), "c"))).alias("e"))
              .groupBy("e.section", "e.item").agg(F.sum("e.c").alias("n")).select("section", "item", "n", none))
    found = patterns.agg(F.count("*").alias("n")).select(
        F.lit("patterns").alias("section"), F.lit("total").alias("item"), "n", none)
    status = feed_log.select(F.lit("feed").alias("section"), F.concat_ws(":", "feed_name", "status").alias("item"),
                             F.lit(1).cast("long").alias("n"), F.col("last_update").alias("at"))
    return counts.unionByName(found).unionByName(status).orderBy("section", F.desc("at"), "item")
