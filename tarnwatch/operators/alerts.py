"""Alert rules, creation, deduplication, search and statistics."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch.functions.columns import all_of, any_of, cases, count_if, lookup
from tarnwatch.functions.text import alert_description, md5_id, recommended_action
from tarnwatch.operators.scan import map_sorted_groups, with_lookback


@dataclass(frozen=True)
class AlertRule:
    """A row of the alert rule table; an empty type list means every type."""

    rule_id: str
    confidence_threshold: float
    attack_types: tuple[str, ...] = ()
    severity_mapping: dict[str, str] = field(default_factory=dict)
    enabled: bool = True

    def matches(self) -> Column:
        conditions = [F.col("confidence_score") >= self.confidence_threshold]
        if self.attack_types:
            conditions.append(F.coalesce(F.col("attack_type").isin(*self.attack_types), F.lit(False)))
        return all_of(conditions)


# fixed values: the default rule table
DEFAULT_RULES = (
    AlertRule("high_confidence_malicious", 0.9, (), {
        "DoS": "HIGH", "DDoS": "CRITICAL", "Probe": "MEDIUM", "R2L": "HIGH", "U2R": "CRITICAL",
        "Brute Force": "HIGH", "Port Scan": "MEDIUM", "Malware": "CRITICAL"}),
    AlertRule("medium_confidence_critical_attacks", 0.7, ("DDoS", "U2R", "Malware"), {
        "DDoS": "HIGH", "U2R": "HIGH", "Malware": "HIGH"}),
    AlertRule("low_confidence_monitoring", 0.5, ("Probe", "Port Scan"), {
        "Probe": "LOW", "Port Scan": "LOW"}),
)
DEDUP_KEY = ["source_ip", "destination_ip", "attack_type"]


def should_alert(predictions: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """Malicious predictions accepted by any enabled rule. Rules become one predicate: no join."""
    return predictions.where(F.col("is_malicious") & any_of([r.matches() for r in rules if r.enabled]))


def severity_column(rules=DEFAULT_RULES) -> Column:
    """Severity by the first rule that matches and maps the type, else by confidence."""
    kind = F.coalesce(F.col("attack_type"), F.lit("Unknown"))
    by_rule = [F.when(r.matches(), lookup(kind, r.severity_mapping))
               for r in rules if r.enabled and r.severity_mapping]
    fallback = cases([(F.col("confidence_score") >= 0.9, "HIGH"),
                      (F.col("confidence_score") >= 0.7, "MEDIUM")], "LOW")
    return F.coalesce(*by_rule, fallback)


def alert_severity(predictions: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    return predictions.withColumn("severity", severity_column(rules))


def alert_rows(scored_traffic: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """Alert rows when prediction and traffic columns already sit on one row."""
    return alert_severity(should_alert(scored_traffic, rules), rules).select(
        "record_id", "ts", "source_ip", "destination_ip", "source_port", "destination_port",
        "protocol", "packet_size", "duration", F.coalesce(F.col("attack_type"), F.lit("Unknown")).alias("attack_type"),
        "confidence_score", "model_version", "severity")


def create_alerts(predictions: DataFrame, traffic: DataFrame, rules=DEFAULT_RULES,
                  importance: str | None = None) -> DataFrame:
    """Predictions joined with their traffic record, rendered as alert rows."""
    wanted = ["record_id", "source_ip", "destination_ip", "source_port", "destination_port",
              "protocol", "packet_size", "duration"]
    joined = alert_severity(should_alert(predictions, rules), rules).join(
        traffic.select(*wanted), "record_id")
    return joined.select(
        md5_id(["record_id", "ts"], 16).alias("alert_id"), "record_id", "ts", "severity",
        F.coalesce(F.col("attack_type"), F.lit("Unknown")).alias("attack_type"),
        "source_ip", "destination_ip", "confidence_score",
        alert_description(importance).alias("description"),
        recommended_action("attack_type", "severity").alias("recommended_action"))


# --- greedy suppression -------------------------------------------------------

def _codes(group: np.ndarray, ts: np.ndarray, span: int) -> np.ndarray:
    """Monotone code so one searchsorted works inside every group."""
    return group.astype(np.int64) * span + ts


NONE_YET = np.iinfo(np.int64).min  # nothing was kept before
ANY_TIME = np.iinfo(np.int64).max  # upper limit of a step that takes all later times


def _starts(*parts: np.ndarray) -> np.ndarray:
    """Whether each row is the first one with its values."""
    first = np.zeros(len(parts[0]), dtype=bool)
    first[:1] = True
    for part in parts:
        first[1:] |= part[1:] != part[:-1]
    return first


def _ends(*parts: np.ndarray) -> np.ndarray:
    """Whether each row is the last one with its values."""
    return np.r_[_starts(*parts)[1:], len(parts[0]) > 0]


def _follow(limits: np.ndarray, exits: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Last kept times after a bucket, for last kept times before it."""
    at = np.searchsorted(limits, np.where(last == NONE_YET, NONE_YET, last + window))
    return np.where(at < len(limits), exits[np.minimum(at, len(limits) - 1)], last)


def keep_spaced(df: DataFrame, keys: list[str], window_seconds: float, ts: str = "ts",
                id_col: str = "record_id", bucket_windows: int = 24, group_buckets: int = 64) -> DataFrame:
    """Keep a row iff it lies at least ``window`` after the last *kept* row of its key.

    The greedy chain is sequential per key, so a hot key is cut into time buckets of
    ``bucket_windows`` windows. What a bucket does to the chain is a step function "last
    kept before -> last kept after". Only instants inside the first window of a bucket (or
    its very first instant) can be the first kept one, and chains from neighbouring
    instants soon meet, so the function has few steps. ``group_buckets`` neighbouring
    functions are composed to that of their group, whose chains have met even more, and
    only the groups of a key are followed one after the other. The last kept time then goes
    down again, from groups to buckets, and each bucket replays its own part. Rows sharing
    an instant are reduced to the smallest id beforehand, which is exact.
    """
    window = int(round(window_seconds * 1_000_000))
    width = window * bucket_windows
    instants = (df.groupBy(*keys, F.unix_micros(F.col(ts)).alias("_t"))
                .agg(F.min(id_col).alias("_id"))
                .withColumn("_b", F.floor(F.col("_t") / F.lit(width)).cast("long")))
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                           for f in df.select(*keys).schema.fields)

    def chain(t: np.ndarray, group: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Index of the next kept instant after each one; itself when outside the bucket."""
        offset = t - base
        codes = _codes(group, offset, 2 * width)
        nxt = np.searchsorted(codes, codes + window, side="left")
        here = np.arange(len(t))
        inside = nxt < len(t)
        nxt = np.where(inside, nxt, here)
        return np.where(group[nxt] == group, nxt, here)

    def summarise(rows: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        """Steps of every bucket: all first kept times up to ``_limit`` lead to ``_exit``."""
        t = rows["_t"].to_numpy()
        base = rows["_b"].to_numpy() * width
        end = chain(t, group, base)
        for _ in range(int(np.ceil(np.log2(bucket_windows))) + 2):
            end = end[end]
        entry = _starts(group) | (t - base < window)
        # the instant that follows the first window can also start the bucket
        entry[1:] |= (entry[:-1] & ~entry[1:] & (group[1:] == group[:-1]))
        at = np.flatnonzero(entry)
        at = at[_ends(group[at], end[at])]
        out = rows.iloc[at][[*keys, "_b"]].copy()
        out["_g"] = out["_b"] // group_buckets
        out["_limit"], out["_exit"] = t[at], t[end[at]]
        return out[[*keys, "_g", "_b", "_limit", "_exit"]]

    steps = map_sorted_groups(instants.select(*keys, "_b", "_t"), [*keys, "_b"], ["_t"], summarise,
                              f"{key_schema}, _g long, _b long, _limit long, _exit long")

    def compose(rows: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        """The steps of a group: those of its first bucket, led through all others."""
        limit, leave, bucket = (rows[c].to_numpy() for c in ("_limit", "_exit", "_b"))
        begin = np.flatnonzero(_starts(group, bucket))
        stop = np.r_[begin[1:], len(rows)]
        firsts, pieces = np.flatnonzero(_starts(group[begin])), []
        for first, end in zip(firsts, np.r_[firsts[1:], len(begin)]):
            limits, last = limit[begin[first]:stop[first]], leave[begin[first]:stop[first]]
            if first + 1 < end:  # a time behind all instants of the first bucket opens the second one
                limits, last = np.r_[limits, ANY_TIME], np.r_[last, NONE_YET]
            for i in range(first + 1, end):
                last = _follow(limit[begin[i]:stop[i]], leave[begin[i]:stop[i]], last, window)
            kept = _ends(last)
            pieces.append((np.full(int(kept.sum()), begin[first]), limits[kept], last[kept]))
        at, limits, last = (np.concatenate(p) for p in zip(*pieces))
        out = rows.iloc[at][[*keys, "_g"]].copy()
        out["_limit"], out["_exit"] = limits, last
        return out

    groups = map_sorted_groups(steps, [*keys, "_g"], ["_b", "_limit"], compose,
                               f"{key_schema}, _g long, _limit long, _exit long")

    def lead(part: str):
        """Follow the parts of each group of rows in turn, from ``_last`` if there; gives the last kept time before each."""
        def run(rows: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
            limit, leave, number = (rows[c].to_numpy() for c in ("_limit", "_exit", part))
            known = rows["_last"].to_numpy() if "_last" in rows else np.full(len(rows), NONE_YET)
            begin = np.flatnonzero(_starts(group, number))
            stop = np.r_[begin[1:], len(rows)]
            opens = _starts(group[begin])
            before = np.empty(len(begin), dtype=np.int64)
            last = NONE_YET
            for i, (lo, hi) in enumerate(zip(begin, stop)):
                if opens[i]:
                    last = known[lo]
                before[i] = last
                at = lo if last == NONE_YET else lo + int(np.searchsorted(limit[lo:hi], last + window))
                if at < hi:
                    last = leave[at]
            out = rows.iloc[begin][[*keys, part]].copy()
            out["_last"] = before
            return out
        return run

    def attach(left: DataFrame, part: str, right: DataFrame) -> DataFrame:
        known = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(part).alias("_k_part"), "_last")
        same = F.col(part) == F.col("_k_part")
        for k in keys:  # rows with a missing key form a group of their own, as in any grouping
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        return left.join(known, same).select(*left.columns, "_last")

    of_groups = map_sorted_groups(groups, keys, ["_g", "_limit"], lead("_g"), f"{key_schema}, _g long, _last long")
    of_buckets = map_sorted_groups(attach(steps, "_g", of_groups), [*keys, "_g"], ["_b", "_limit"], lead("_b"),
                                   f"{key_schema}, _b long, _last long")
    placed = attach(instants, "_b", of_buckets)

    def replay(rows: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        t, last = rows["_t"].to_numpy(), rows["_last"].to_numpy()
        nxt = chain(t, group, rows["_b"].to_numpy() * width)
        free = t >= np.where(last == NONE_YET, NONE_YET, last + window)
        kept = free & (_starts(group) | ~np.r_[False, free[:-1]])
        front = np.flatnonzero(kept)
        while len(front):
            step = nxt[front]
            front = step[step != front]
            kept[front] = True
        return rows.loc[kept, ["_id"]]

    id_type = df.schema[id_col].dataType.simpleString()
    kept = map_sorted_groups(placed, [*keys, "_b"], ["_t"], replay, f"_id {id_type}")
    return df.join(kept, F.col(id_col) == F.col("_id"), "left_semi")


def dedup_alerts(alerts: DataFrame, window_seconds: float = 300, id_col: str = "record_id") -> DataFrame:
    """Suppress repeats of (source, target, type) inside the window of the last kept alert."""
    return keep_spaced(alerts, DEDUP_KEY, window_seconds, id_col=id_col)


def trailing_counts(df: DataFrame, keys: list[str], window_seconds: float, name: str,
                    ts: str = "ts", id_col: str = "record_id") -> DataFrame:
    """``(id, name)``: rows of the same key in the closed window ending at each row."""
    window = int(round(window_seconds * 1_000_000))
    width = int(np.ceil(window_seconds)) * 6
    span = 4 * width * 1_000_000
    base = with_lookback(df.select(*keys, ts, id_col), ts, width, window_seconds + 1e-6)
    base = base.withColumn("_t", F.unix_micros(F.col(ts))).drop(ts)

    def count(rows: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        t = rows["_t"].to_numpy()
        offset = t - (rows["_bucket"].to_numpy() - 1) * width * 1_000_000
        codes = _codes(group, offset, span)
        upto = np.searchsorted(codes, codes, side="right")
        since = np.searchsorted(codes, codes - window, side="left")
        floor = np.searchsorted(group, group, side="left")
        out = pd.DataFrame({"_id": rows[id_col], name: upto - np.maximum(since, floor)})
        return out[rows["_own"].to_numpy()]

    id_type = df.schema[id_col].dataType.simpleString()
    return map_sorted_groups(base, [*keys, "_bucket"], ["_t"], count, f"_id {id_type}, {name} long"
                             ).withColumnRenamed("_id", id_col)


def escalate_alerts(alerts: DataFrame, n: int = 3, window_seconds: float = 600,
                    severity: str = "CRITICAL") -> DataFrame:
    """Raise alerts that close a window holding at least ``n`` similar ones."""
    counts = trailing_counts(alerts, DEDUP_KEY, window_seconds, "similar_count")
    return (alerts.join(counts, "record_id")
            .withColumn("escalated", F.col("similar_count") >= n)
            .withColumn("severity", F.when(F.col("escalated"), severity).otherwise(F.col("severity"))))


def alert_stats(alerts: DataFrame, deduplicated: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """(section, item, n) rows: totals, by severity, by type, suppressed, active rules."""
    row = lambda section, item, n: (F.lit(section).alias("section"), item.alias("item"), n.alias("n"))
    # one pass over the alerts for totals, severities and types
    grouped = alerts.groupBy("severity", "attack_type").agg(F.count("*").alias("c"))
    pieces = grouped.select(F.explode(F.array(
        F.struct(F.lit("total").alias("section"), F.lit("generated").alias("item"), "c"),
        F.struct(F.lit("severity").alias("section"), F.col("severity").alias("item"), "c"),
        F.struct(F.lit("type").alias("section"), F.col("attack_type").alias("item"), "c"))).alias("e"))
    counts = pieces.groupBy("e.section", "e.item").agg(F.sum("e.c").alias("n"))
    balance = grouped.select("c").unionAll(deduplicated.agg((-F.count("*")).alias("c")))
    suppressed = balance.agg(F.sum("c").alias("c")).select(
        *row("total", F.lit("deduplicated"), F.col("c")))
    active = alerts.sparkSession.range(1).select(
        *row("rules", F.lit("active"), F.lit(sum(r.enabled for r in rules)).cast("long")))
    return counts.unionByName(suppressed).unionByName(active)


def search_alerts(alerts: DataFrame, start: datetime | None = None, end: datetime | None = None,
                  severities=None, attack_types=None, statuses=None, source_contains=None,
                  min_confidence=None, limit: int | None = None, id_col: str = "record_id") -> DataFrame:
    """Filtered alerts, newest first. Only given filters appear in the plan."""
    conditions = []
    if start is not None:
        conditions.append(F.col("ts") >= F.lit(start))
    if end is not None:
        conditions.append(F.col("ts") <= F.lit(end))
    for name, values in (("severity", severities), ("attack_type", attack_types), ("status", statuses)):
        if values:
            conditions.append(F.col(name).isin(*values))
    if source_contains:
        conditions.append(F.col("source_ip").contains(source_contains))
    if min_confidence is not None:
        conditions.append(F.col("confidence_score") >= min_confidence)
    found = alerts.where(all_of(conditions)).orderBy(F.desc("ts"), F.col(id_col))
    return found.limit(limit) if limit else found


def delivery_stats(log: DataFrame) -> DataFrame:
    """Deliveries per alert (sent if any channel succeeded), by channel and by severity."""
    per_alert = log.groupBy("alert_id", "severity").agg(F.max(F.col("success").cast("int")).alias("sent"))
    outcome = F.when(F.col("sent") == 1, "sent").otherwise("failed")
    per_alert = per_alert.groupBy("severity", outcome.alias("outcome")).agg(F.count("*").alias("c"))
    alert_rows_ = per_alert.select(F.explode(F.array(
        F.struct(F.lit("alerts").alias("section"), F.col("outcome").alias("item"), "c"),
        F.struct(F.lit("severity").alias("section"),
                 F.concat_ws(":", "severity", "outcome").alias("item"), "c"))).alias("e")
    ).groupBy("e.section", "e.item").agg(F.sum("e.c").alias("n"))
    by_channel = log.groupBy(
        F.lit("channel").alias("section"),
        F.concat_ws(":", "channel", F.when(F.col("success"), "sent").otherwise("failed")).alias("item")
    ).agg(F.count("*").alias("n"))
    return alert_rows_.unionByName(by_channel)


def rule_match_counts(predictions: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """How many malicious predictions each enabled rule accepts, in one pass."""
    enabled = [r for r in rules if r.enabled]
    return predictions.where("is_malicious").agg(*[count_if(r.matches()).alias(r.rule_id) for r in enabled])
