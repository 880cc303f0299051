"""Column functions that build or clean text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.columns import cases, col, count_if, lookup  # noqa: F401


def md5_id(parts: list, length: int, sep: str = ":") -> Column:
    """First hex digits of the md5 of the joined parts."""
    return F.substring(F.md5(F.concat_ws(sep, *[col(p).cast("string") for p in parts])), 1, length)


def redact(message) -> Column:
    sensitive = F.lower(col(message)).rlike("|".join(K.SENSITIVE_WORDS))
    return F.when(sensitive, F.lit(K.REDACTED)).otherwise(col(message))


def sanitize(text) -> Column:
    return F.trim(F.translate(col(text), K.UNSAFE_CHARS, ""))


def too_long(text, max_len: int = K.MAX_TEXT) -> Column:
    """Whether a text must be rejected for its length; null is no text and not too long."""
    return F.coalesce(F.length(col(text)) > max_len, F.lit(False))


def sanitize_or_reject(text, max_len: int = K.MAX_TEXT) -> Column:
    """Struct (clean, rejected): the sanitised text, or null and true for one that is too long."""
    over = too_long(text, max_len)
    return F.struct(F.when(~over, sanitize(text)).alias("clean"), over.alias("rejected"))


def confidence_bin(score) -> Column:
    return cases([(col(score) >= low, F.lit(name)) for low, name in K.CONFIDENCE_BINS],
                 F.lit(K.LOWEST_CONFIDENCE_BIN))


def top_importance(importance, n: int = 3) -> Column:
    """``name: value`` of the n entries with the largest absolute value."""
    entries = F.map_entries(col(importance))
    ranked = F.array_sort(entries, lambda a, b: F.when(
        F.abs(a["value"]) != F.abs(b["value"]),
        F.when(F.abs(a["value"]) > F.abs(b["value"]), F.lit(-1)).otherwise(F.lit(1)))
        .otherwise(F.when(a["key"] < b["key"], F.lit(-1)).otherwise(F.lit(1))))
    return F.array_join(F.transform(F.slice(ranked, 1, n),
                                    lambda e: F.format_string("%s: %.3f", e["key"], e["value"])), ", ")


def alert_description(importance=None) -> Column:
    """Sentence describing an alert row; needs the traffic columns next to the prediction."""
    # fixed values: the sentence
    text = F.format_string(
        "Detected %s from %s:%d to %s:%d using %s protocol. Confidence: %d%%. "
        "Packet size: %d bytes, Duration: %.2fs.",
        F.coalesce(F.col("attack_type"), F.lit("malicious activity")),
        F.col("source_ip"), F.col("source_port"), F.col("destination_ip"),
        F.col("destination_port"), F.col("protocol"),
        (F.col("confidence_score") * 100).cast("int"), F.col("packet_size"), F.col("duration"))
    if importance is None:
        return text
    has = F.coalesce(F.size(col(importance)) > 0, F.lit(False))
    return F.when(has, F.concat(text, F.lit(" Key indicators: "), top_importance(importance),
                                F.lit("."))).otherwise(text)


def recommended_action(attack_type, severity) -> Column:
    return F.concat(lookup(col(attack_type), K.RECOMMENDED_ACTIONS, K.DEFAULT_ACTION),
                    lookup(col(severity), K.ACTION_SUFFIX, K.DEFAULT_ACTION_SUFFIX))


def percent(score, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", col(score) * 100)


def alert_payload(style: str) -> Column:
    """Message body for a delivery channel: standard, slack, teams or text."""
    if style == "text":
        return F.format_string("ALERT [%s] %s - %s -> %s (confidence: %s) - %s",
                               F.col("severity"), F.col("attack_type"), F.col("source_ip"),
                               F.col("destination_ip"), percent("confidence_score"),
                               F.col("description"))
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss 'UTC'")
    if style == "standard":
        return F.to_json(F.struct(
            "alert_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "severity",
            "attack_type", "source_ip", "destination_ip", "confidence_score", "description",
            "recommended_action"))
    if style == "slack":
        fields = [("Attack Type", F.col("attack_type"), True), ("Severity", F.col("severity"), True),
                  ("Source IP", F.col("source_ip"), True),
                  ("Destination IP", F.col("destination_ip"), True),
                  ("Confidence", percent("confidence_score"), True), ("Timestamp", stamp, True),
                  ("Description", F.col("description"), False),
                  ("Recommended Action", F.col("recommended_action"), False)]
        attachment = F.struct(
            lookup("severity", K.SLACK_COLORS, "warning").alias("color"),
            F.array(*[F.struct(F.lit(title).alias("title"), value.alias("value"),
                               F.lit(short).alias("short")) for title, value, short in fields])
            .alias("fields"),
            F.lit("Network security analytics").alias("footer"),
            F.unix_seconds("ts").alias("ts"))
        return F.to_json(F.struct(
            F.concat(F.lit("Intrusion alert - "), F.col("severity")).alias("text"),
            F.array(attachment).alias("attachments")))
    if style == "teams":
        facts = [("Source IP", F.col("source_ip")), ("Destination IP", F.col("destination_ip")),
                 ("Confidence", percent("confidence_score")), ("Timestamp", stamp)]
        section = F.struct(
            F.concat(F.lit("Intrusion alert - "), F.col("severity")).alias("activityTitle"),
            F.concat(F.col("attack_type"), F.lit(" detected")).alias("activitySubtitle"),
            F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in facts]).alias("facts"),
            F.format_string("**Description:** %s\n\n**Recommended Action:** %s",
                            F.col("description"), F.col("recommended_action")).alias("text"))
        return F.to_json(F.struct(
            F.lit("MessageCard").alias("@type"), F.lit("http://schema.org/extensions").alias("@context"),
            lookup("severity", K.TEAMS_COLORS, "6c757d").alias("themeColor"),
            F.concat(F.lit("Alert - "), F.col("attack_type")).alias("summary"),
            F.array(section).alias("sections")))
    raise ValueError(f"unknown payload style {style!r}")
