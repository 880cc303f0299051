"""Correlation of alerts into kill-chain sequences, campaigns and priorities."""

from __future__ import annotations

import copy
from dataclasses import dataclass
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.columns import cases, count_if, lookup
from tarnwatch.functions.text import md5_id
from tarnwatch.operators.features import attack_stage, stage_index
from tarnwatch.operators.graph import chained_components, connected_components
from tarnwatch.operators.scan import map_sorted_groups, range_ranks, running, time_bucket, with_lookback
from tarnwatch.session import cut, kept_table

DAY = 86_400
#: Seconds of a slice of a rule key's time line, and slices of a group, for running values over it.
MARK_SLICE, MARK_GROUP = 600, 144


@dataclass(frozen=True)
class CorrelationRule:
    rule_id: str
    window_seconds: int
    min_events: int
    max_events: int
    sequence: tuple[str, ...] = ()
    same_source: bool = False
    same_target: bool = False
    multiple_sources: bool = False
    kill_chain: bool = False
    escalating: bool = False
    similar_types: bool = False
    enabled: bool = True


# fixed values: the default rule table. ``lateral_movement`` names conditions nothing evaluates, so it
# never gathers the two events it asks for.
DEFAULT_RULES = (
    CorrelationRule("reconnaissance_to_exploitation", 7_200, 2, 10, ("Probe", "Port Scan", "Brute Force"), same_source=True),
    CorrelationRule("multi_stage_attack", 21_600, 3, 20, same_source=True, kill_chain=True, escalating=True),
    CorrelationRule("coordinated_attack", 1_800, 3, 50, same_target=True, multiple_sources=True, similar_types=True),
    CorrelationRule("lateral_movement", 14_400, 2, 15),
)


# --- events ------------------------------------------------------------------------

def severity_index(severity) -> Column:
    c = F.col(severity) if isinstance(severity, str) else severity
    return lookup(F.lower(c), {s: i for i, s in enumerate(K.SEVERITY_ORDER)})


def with_stage(df: DataFrame) -> DataFrame:
    return df.withColumns({"stage": attack_stage("attack_type"), "sev_idx": severity_index("severity")}).withColumn(
        "stage_idx", stage_index("stage"))


def correlated_events(alerts: DataFrame, predictions: DataFrame, traffic: DataFrame) -> DataFrame:
    """Alerts with kill-chain stage and the context of their prediction and traffic record."""
    t = traffic.select("record_id", "protocol", "source_port", "destination_port", "packet_size", "duration", "flags")
    joined = with_stage(alerts).join(predictions.select("record_id", "model_version"), "record_id").join(t, "record_id")
    data = F.struct("alert_id", F.col("record_id").alias("prediction_id"), "protocol", "source_port", "destination_port",
                    "packet_size", "duration", "flags", "model_version", "severity", "description", "recommended_action")
    return joined.select(F.col("record_id").alias("event_id"), "ts", "source_ip", "destination_ip", "attack_type",
                         "confidence_score", "stage", "stage_idx", "sev_idx", "severity", data.alias("event_data"))


def attack_edges(events: DataFrame) -> DataFrame:
    """One edge per (source, target) with the attributes of the newest event."""
    newest = F.max_by(F.struct("attack_type", "confidence_score", "stage", "ts"), F.struct("ts", "event_id"))
    return events.groupBy("source_ip", "destination_ip").agg(newest.alias("e")).select("source_ip", "destination_ip", "e.*")


def attack_nodes(events: DataFrame) -> DataFrame:
    """Addresses with their latest role and time of last sight."""
    ends = events.select("ts", "event_id", F.explode(F.array(
        F.struct(F.col("source_ip").alias("ip"), F.lit(0).alias("o"), F.lit("source").alias("role")),
        F.struct(F.col("destination_ip").alias("ip"), F.lit(1).alias("o"), F.lit("target").alias("role")))).alias("n"))
    return ends.groupBy("n.ip").agg(F.max_by("n.role", F.struct("ts", "event_id", "n.o")).alias("role"),
                                    F.max("ts").alias("last_seen"))


# --- rules, one pass per rule --------------------------------------------------------

def rule_slice(rule: CorrelationRule) -> int:
    """Slice width: long windows get slices of their own length, so that a busy key is cut finely."""
    return rule.window_seconds * (4 if rule.window_seconds < 3_600 else 1) + 1


def _rule_groups(events: DataFrame, rule: CorrelationRule) -> DataFrame:
    """Events per rule key and time slice, with the rule window copied in front of each slice."""
    key = F.concat_ws("|", *([F.col("source_ip")] if rule.same_source else []),
                      *([F.col("destination_ip")] if rule.same_target else []))
    slim = events.select(key.alias("_key"), "ts", "event_id", "attack_type", "source_ip",
                         F.coalesce("stage_idx", F.lit(-1)).alias("stage_idx"),
                         F.coalesce("sev_idx", F.lit(-1)).alias("sev_idx"))
    return with_lookback(slim, "ts", rule_slice(rule), rule.window_seconds + 1e-6).withColumn(
        "_t", F.unix_micros("ts")).drop("ts")


class _Window:
    """Positions of a rule window inside a flat array of sorted groups.

    ``part`` restricts the evaluated rows; what concerns all rows (positions per
    level, next higher level) is computed once and shared between parts.
    """

    def __init__(self, rows: pd.DataFrame, group: np.ndarray, rule: CorrelationRule, span: int | None = None):
        width = rule_slice(rule) * 1_000_000
        offset = rows["_t"].to_numpy() - (rows["_bucket"].to_numpy() - 1) * width
        codes = group.astype(np.int64) * (span or 4 * width) + offset
        self.n = len(rows)
        self.at = self.every = np.arange(self.n)
        first = np.searchsorted(group, group, side="left")
        self.start = np.maximum(np.searchsorted(codes, codes - rule.window_seconds * 1_000_000), first)
        self.known: dict = {}

    def part(self, index) -> _Window:
        w = copy.copy(self)
        w.at, w.start = self.at[index], self.start[index]
        return w

    def _positions(self, name: str, values: np.ndarray, wanted) -> np.ndarray:
        key = (name, wanted)
        if key not in self.known:
            self.known[key] = np.flatnonzero(values == wanted)
        return self.known[key]

    def newest(self, positions: np.ndarray, stop: np.ndarray, keep: int):
        """(count, matrix): the last ``keep`` of ``positions`` inside [start, stop) per row, -1 padded."""
        hi, lo = np.searchsorted(positions, stop), np.searchsorted(positions, self.start)
        idx = hi[:, None] - 1 - np.arange(keep)[None, :]
        safe = positions[np.clip(idx, 0, max(len(positions) - 1, 0))] if len(positions) else np.full(idx.shape, -1)
        return hi - lo, np.where(idx >= lo[:, None], safe, -1)

    def non_decreasing(self, name: str, level: np.ndarray, keep: int) -> np.ndarray:
        """Rows of the window accepted while levels must not fall; rows without a level (-1) are skipped.

        A row of level k is accepted iff no higher level came before it in the window.
        """
        total, parts = np.zeros(len(self.at), dtype=np.int64), []
        if name not in self.known:
            self.known[name] = np.unique(level[level >= 0])
        for k in self.known[name]:
            key = (name, "higher", k)
            if key not in self.known:
                higher = np.where(level > k, self.every, self.n)
                self.known[key] = np.minimum.accumulate(higher[::-1])[::-1]
            stop = np.minimum(self.at + 1, self.known[key][self.start])
            count, found = self.newest(self._positions(name, level, k), stop, keep)
            total += count
            parts.append(found)
        if not parts:
            return np.full((len(self.at), 1), -1)
        return np.where((total >= 2)[:, None], np.hstack(parts), -1)

    def ordered(self, kinds: np.ndarray, pattern: tuple[str, ...]) -> np.ndarray:
        """Greedy ordered occurrence of the pattern in the window; -1 rows when incomplete."""
        found, after = [], self.start - 1
        for kind in pattern:
            positions = np.append(self._positions("kind", kinds, kind), self.n)
            after = positions[np.searchsorted(positions, np.minimum(after, self.n - 1), side="right")]
            found.append(after)
        complete = found[-1] <= self.at
        return np.where(complete[:, None], np.column_stack(found), -1)

    def similar(self, groups: np.ndarray, keep: int) -> np.ndarray:
        """The newest rows of the window in the same similarity group."""
        found = np.full((len(self.at), keep), -1)
        mine = groups[self.at]
        for kind in pd.unique(mine):
            rows = np.flatnonzero(mine == kind)
            w = self.part(slice(None)) if len(rows) == len(self.at) else self.part(rows)
            found[rows] = w.newest(self._positions("similar", groups, kind), w.at, keep)[1]
        return found

    def several(self, values: np.ndarray) -> np.ndarray:
        """Does the window hold a value different from the row's own?"""
        if "other" not in self.known:
            changed = np.r_[False, values[1:] != values[:-1]]
            self.known["other"] = np.maximum.accumulate(np.where(changed, self.every - 1, -1))
        return self.known["other"][self.at] >= self.start


def similar_group(attack_type) -> Column:
    """Attack types are similar iff this value is equal."""
    groups = {t: names[0] for names in K.SIMILAR_ATTACKS for t in names}
    c = F.col(attack_type) if isinstance(attack_type, str) else attack_type
    return F.coalesce(lookup(c, groups), c)


def _similar(kinds: np.ndarray) -> np.ndarray:
    groups = {t: names[0] for names in K.SIMILAR_ATTACKS for t in names}
    return np.array([groups.get(k, k) for k in kinds], dtype=object)


def _rule_marks(events: DataFrame, rule: CorrelationRule, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Two marks per event on its rule key's time line (``_at``, microseconds): the event and, before it, its window's start.

    A window's start sorts before all events of its instant. With ``kinds`` only events of these types stay, and all starts.
    """
    key = F.concat_ws("|", *([F.col("source_ip")] if rule.same_source else []),
                      *([F.col("destination_ip")] if rule.same_target else []))
    at = F.unix_micros("ts")
    start = F.struct((at - rule.window_seconds * 1_000_000).alias("_at"), F.lit(0).alias("_own"))
    own = F.struct(at.alias("_at"), F.lit(1).alias("_own"))
    both = F.array(start, own) if not kinds else F.when(F.col("attack_type").isin(*kinds), F.array(start, own)).otherwise(F.array(start))
    return events.select(key.alias("_key"), at.alias("_t"), "event_id", "attack_type", "source_ip", F.explode(both).alias("_m")).select(
        "_key", "_t", "event_id", "attack_type", "source_ip", "_m.*")


def rule_candidates(events: DataFrame, rule: CorrelationRule) -> DataFrame:
    """(event_id, rule_id, candidates, multiple_sources): size of the candidate set of every event.

    Candidates are counted, not listed: a busy source would pair every event with
    thousands of others. A multi-source rule without a second source has none.
    The count is the difference of two running counts, at the event and at its window's start; a second source
    is in the window iff the newest earlier event of another source is. Both are running values over slices of
    ``MARK_SLICE`` seconds, so a key may hold any share of the events. Rows that repeat an event are reported once.
    """
    own = F.col("_own") == 1
    slice_ = F.floor(F.col("_at") / F.lit(MARK_SLICE * 1_000_000)).cast("long")
    order = ["_at", "_own", "event_id"]
    marks = cut(running(_rule_marks(events, rule), ["_key"], order, slice_, {
        "_seen": ("count", F.when(own, F.lit(1))),
        "_before": ("last", F.when(own, F.struct("source_ip", "_at")))}, exclusive=True, group=MARK_GROUP))
    other = F.when(own & F.col("_before").isNotNull() & ~F.col("_before.source_ip").eqNullSafe(F.col("source_ip")), F.col("_before._at"))
    known = running(marks, ["_key"], order, slice_, {"_other": ("last", other)}, group=MARK_GROUP)
    counted = known.groupBy("_key", "_t", "event_id").agg(
        (F.max(F.when(own, F.col("_seen"))) - F.max(F.when(~own, F.col("_seen")))).alias("n"), F.max(F.when(own, F.col("_other"))).alias("_other"))
    several = F.coalesce(F.col("_other") >= F.col("_t") - rule.window_seconds * 1_000_000, F.lit(False))
    n = F.when(several, F.col("n")).otherwise(0) if rule.multiple_sources else F.col("n")
    return counted.select("event_id", F.lit(rule.rule_id).alias("rule_id"), n.cast("long").alias("candidates"), several.alias("multiple_sources"))


def match_sequence(events: DataFrame, rule: CorrelationRule) -> DataFrame:
    """(event_id, matched): the ordered pattern in the window ending at each event, where complete.

    What follows an event of the pattern does not depend on the window: from the last type to the first, each event
    takes up the next one's chain by a running value in reverse order over slices of ``MARK_SLICE`` seconds. A window
    matches iff the first chain after its start ends no later than its event.
    """
    rows = _rule_marks(events, rule, rule.sequence).select(
        "_key", "_t", "event_id", "attack_type", (-F.col("_at")).alias("_back"), (-F.col("_own")).alias("_late"), (-F.col("event_id")).alias("_id"))
    slice_ = F.floor(F.col("_back") / F.lit(MARK_SLICE * 1_000_000)).cast("long")
    tail = F.struct(F.array("event_id").alias("ids"), (-F.col("_back")).alias("at"), F.col("event_id").alias("id"))
    for i, kind in enumerate(reversed(rule.sequence)):
        if i:
            rows = cut(rows.withColumnRenamed("_next", "_then"))
            tail = F.when(F.col("_then").isNotNull(), F.struct(F.concat(F.array("event_id"), "_then.ids").alias("ids"), "_then.at", "_then.id"))
        chain = F.when((F.col("_late") == -1) & (F.col("attack_type") == kind), tail)
        rows = running(rows, ["_key"], ["_back", "_late", "_id"], slice_, {"_next": ("last", chain)}, exclusive=True, group=MARK_GROUP).drop("_then")
    ended = F.struct(F.col("_next.at").alias("at"), F.col("_next.id").alias("id")) <= F.struct(F.col("_t").alias("at"), F.col("event_id").alias("id"))
    return rows.where((F.col("_late") == 0) & F.col("_next").isNotNull() & ended).select("event_id", F.col("_next.ids").alias("matched"))


CHUNK_ROWS = 20_000


def rule_matcher(rule: CorrelationRule):
    """Function (sorted rows, group numbers) -> matches of the rows marked ``_own``.

    Rows are evaluated in chunks, so the matrix of candidates stays small however
    large a group is.
    """
    keep = rule.max_events

    def match(rows: pd.DataFrame, group: np.ndarray, span: int | None = None) -> pd.DataFrame:
        whole = _Window(rows, group, rule, span)
        kinds, sources = rows["attack_type"].to_numpy(), rows["source_ip"].to_numpy()
        stages, severities = rows["stage_idx"].to_numpy(), rows["sev_idx"].to_numpy()
        groups = _similar(kinds) if rule.similar_types else None
        ids, own = rows["event_id"].to_numpy(), np.flatnonzero(rows["_own"].to_numpy())
        events, lists = [], []
        for lo in range(0, len(own), CHUNK_ROWS):
            w = whole.part(own[lo:lo + CHUNK_ROWS])
            parts = [w.at[:, None]]
            if rule.sequence:
                parts.append(w.ordered(kinds, rule.sequence))
            if rule.kill_chain:
                parts.append(w.non_decreasing("stage", stages, keep))
            if rule.similar_types:
                parts.append(w.similar(groups, keep))
            if rule.escalating:
                parts.append(w.non_decreasing("severity", severities, keep))
            all_ = -np.sort(-np.hstack(parts), axis=1)
            fresh = all_ >= 0
            fresh[:, 1:] &= all_[:, 1:] != all_[:, :-1]
            fresh &= np.cumsum(fresh, axis=1) <= keep
            size = fresh.sum(axis=1)
            take = size >= rule.min_events
            if rule.multiple_sources:
                take &= w.several(sources)
            if take.any():
                # oldest first: reverse the newest-first layout
                flat = ids[all_[take][:, ::-1][fresh[take][:, ::-1]]]
                lists += np.split(flat, np.cumsum(size[take])[:-1])
                events.append(ids[w.at[take]])
        found = np.concatenate(events) if events else np.empty(0, dtype=np.int64)
        return pd.DataFrame({"event_id": found, "rule_id": rule.rule_id, "matched": lists})

    return match


def _apply_rule(events: DataFrame, rule: CorrelationRule) -> DataFrame:
    return map_sorted_groups(_rule_groups(events, rule), ["_key", "_bucket"], ["_t", "event_id"], rule_matcher(rule),
                             "event_id long, rule_id string, matched array<long>")


def apply_rules(events: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """(event_id, rule_id, matched): for every event and rule the correlated events, oldest first.

    The event itself belongs to its match; at most ``max_events`` newest are kept,
    groups below ``min_events`` are dropped.
    """
    active = [r for r in rules if r.enabled and (r.min_events <= 1 or r.sequence or r.kill_chain
                                                 or r.similar_types or r.escalating)]
    out = None
    for rule in active:
        part = _apply_rule(events, rule)
        out = part if out is None else out.unionByName(part)
    return out


def _progression(events: DataFrame, level: str, bucket_seconds: int) -> DataFrame:
    known = events.where(F.col(level).isNotNull())
    before = running(known, ["source_ip"], ["ts", "event_id"], time_bucket("ts", bucket_seconds),
                     {"_seen": ("max", F.col(level))}, exclusive=True)
    accepted = before.where(F.col("_seen").isNull() | (F.col(level) >= F.col("_seen"))).drop("_seen")
    enough = accepted.groupBy("source_ip").agg(F.count("*").alias("_n")).where("_n >= 2")
    return accepted.join(enough.select("source_ip"), "source_ip", "left_semi")


def kill_chain_progression(events: DataFrame, bucket_seconds: int = 3_600) -> DataFrame:
    """Events whose stage is not below any earlier accepted stage of their source (two or more)."""
    return _progression(events, "stage_idx", bucket_seconds)


def escalating_severity(events: DataFrame, bucket_seconds: int = 3_600) -> DataFrame:
    return _progression(events, "sev_idx", bucket_seconds)


# --- sequences ---------------------------------------------------------------------------

def sequence_members(matches: DataFrame, events: DataFrame) -> DataFrame:
    """Events with ``sequence_id``: matches that share an event belong together.

    Neighbouring events of a match are linked; overlapping windows repeat the same links, so matches are reduced to
    connected parts where they are made, before components are searched.
    """
    groups = chained_components(matches.where(F.size("matched") >= 2), "matched")
    return events.join(groups.select(F.col("node").alias("event_id"), F.col("component").alias("sequence_id")), "event_id")


def progression_score(stages: Column) -> Column:
    """Score of the stage order (distinct stages as first seen)."""
    n = F.size(stages)
    steps = F.aggregate(F.sequence(F.lit(2), n), F.lit(0), lambda acc, i: acc + F.when(
        F.element_at(stages, i) >= F.element_at(stages, i - 1), 1).otherwise(0))
    # fixed values: weights of order and coverage
    score = 0.7 * (steps / (n - 1)) + 0.3 * (n / F.lit(float(len(K.KILL_CHAIN_STAGES))))
    return cases([(n == 0, F.lit(0.0)), (n == 1, F.lit(0.5))], F.least(score, F.lit(1.0)))


def sequence_severity(events: Column, hours: Column, progression: Column, confidence: Column, stages: Column,
                      types: Column) -> Column:
    # fixed values: weights, caps and limits of the severity
    score = (F.least(events / 10, F.lit(0.3)) + F.least(hours / 24, F.lit(0.2)) + progression * 0.2 + confidence * 0.15
             + F.least(stages / 7, F.lit(0.1)) + F.least(types / 5, F.lit(0.05)))
    return cases([(score >= 0.8, "critical"), (score >= 0.6, "high"), (score >= 0.4, "medium")], "low")


def _duration_text(seconds: Column) -> Column:
    days = F.floor(seconds / DAY)
    clock = F.format_string("%d:%02d:%02d", F.floor(seconds / 3600) % 24, F.floor(seconds / 60) % 60, seconds % 60)
    return cases([(days == 0, clock), (days == 1, F.concat(F.lit("1 day, "), clock))],
                 F.concat(days.cast("string"), F.lit(" days, "), clock))


def sequence_values(members: DataFrame) -> DataFrame:
    """(sequence_id, kind, value): distinct sources, targets and types per sequence, in long form."""
    pairs = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value")) for kind, c in (
        ("source", "source_ip"), ("target", "destination_ip"), ("type", "attack_type"))])).alias("p")
    return members.select("sequence_id", pairs).select("sequence_id", "p.kind", "p.value").distinct()


def describe_sequences(members: DataFrame) -> DataFrame:
    """One row per sequence: span, counts, stages, progression, severity and description.

    Members are first folded per (sequence, stage, type); only that small table is
    turned into arrays. Address counts come from distinct (sequence, address) pairs.
    """
    cells = members.groupBy("sequence_id", "stage", "stage_idx", "attack_type").agg(
        F.count("*").alias("c"), F.min(F.struct("ts", "event_id")).alias("first"), F.max("ts").alias("last"),
        F.max("confidence_score").alias("conf"))
    by_stage = F.collect_list(F.when(F.col("stage_idx").isNotNull(), F.struct("first", "stage_idx", "stage")))
    base = cells.groupBy("sequence_id").agg(
        F.sum("c").alias("event_count"), F.min("first.ts").alias("start_time"), F.max("last").alias("end_time"),
        F.max("conf").alias("max_confidence"), F.array_sort(F.collect_set("attack_type")).alias("attack_types"),
        F.array_sort(by_stage).alias("_order"))
    counts = sequence_values(members).where("kind <> 'type'").groupBy("sequence_id").agg(
        count_if(F.col("kind") == "source").alias("source_count"), count_if(F.col("kind") == "target").alias("target_count"))
    out = base.join(counts, "sequence_id").withColumns({
        "stages": F.array_distinct(F.transform("_order", lambda x: x["stage_idx"])),
        "stage_names": F.array_distinct(F.transform("_order", lambda x: x["stage"])),
        "duration_seconds": F.unix_seconds("end_time") - F.unix_seconds("start_time")}).drop("_order")
    out = out.withColumn("progression_score", progression_score(F.col("stages")))
    out = out.withColumn("severity", sequence_severity(
        F.col("event_count"), F.col("duration_seconds") / 3600, F.col("progression_score"), F.col("max_confidence"),
        F.size("stages"), F.size("attack_types")))
    n_types = F.size("attack_types")
    names = F.array_join(F.transform("stage_names", lambda s: F.initcap(F.regexp_replace(s, "_", " "))), ", ")
    text = F.concat(
        F.format_string("Attack sequence with %d events over %s involving %d attack types: ", "event_count",
                        _duration_text(F.col("duration_seconds")), n_types),
        F.array_join(F.slice("attack_types", 1, 3), ", "),
        F.when(n_types > 3, F.format_string(" and %d others", n_types - 3)).otherwise(""),
        F.format_string(". Sources: %d IPs, Targets: %d IPs.", "source_count", "target_count"),
        F.when(F.size("stages") > 0, F.concat(F.lit(" Kill chain stages: "), names, F.lit("."))).otherwise(""),
        F.format_string(" Progression score: %.2f.", "progression_score"))
    return out.withColumn("description", text)


# --- campaigns ------------------------------------------------------------------------------

def _overlaps(values: DataFrame, kind: str, pairs: DataFrame) -> DataFrame:
    """(a, b, jaccard) of one kind of value for the given sequence pairs."""
    mine = values.where(F.col("kind") == kind)
    size = mine.groupBy("sequence_id").agg(F.count("*").alias("n"))
    left = mine.select(F.col("sequence_id").alias("a"), "value")
    right = mine.select(F.col("sequence_id").alias("b"), "value")
    common = pairs.join(left, "a").join(right, ["b", "value"]).groupBy("a", "b").agg(F.count("*").alias("i"))
    na, nb = size.select(F.col("sequence_id").alias("a"), F.col("n").alias("na")), size.select(
        F.col("sequence_id").alias("b"), F.col("n").alias("nb"))
    return common.join(na, "a").join(nb, "b").select(
        "a", "b", (F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).alias(kind))


KINDS = ("source", "target", "type")
#: Values of a kind that a sequence may have to be compared inside the block join; larger sets stay in long form.
SMALL_SET = 64
#: Later rows of a key that meet its earlier ones in one task; a key with more of them is dealt to several.
SHARE = 4096


def sequence_profiles(sequences: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per sequence: start, sizes and bitmaps of its three sets, and the sets themselves if all are small.

    Values are numbered from rare to frequent; the second table has (sequence_id, kind, value) with these numbers.
    """
    values = values.sparkSession.read.schema(values.schema).parquet(kept_table(values, "plain_values"))  # read by counts and codes
    counts = values.where("value IS NOT NULL").groupBy("kind", "value").agg(F.count("*").alias("n"))
    ranks = range_ranks(counts, ["kind"], ["n", "value"], "rank")
    coded = values.join(ranks.select("kind", "value", "rank"), ["kind", "value"], "left").select(
        "sequence_id", "kind", F.col("rank").alias("value"))
    coded = values.sparkSession.read.schema(coded.schema).parquet(kept_table(coded, "sequence_values"))
    bit = F.expr("shiftleft(1L, CAST(pmod(value, 64) AS INT))")
    sized = coded.groupBy("sequence_id", "kind").agg(F.count("*").alias("n"), F.coalesce(F.bit_or(bit), F.lit(0).cast("long")).alias("m"))
    wide = sized.groupBy("sequence_id").agg(*[F.coalesce(F.max(F.when(F.col("kind") == k, F.col(x))), F.lit(0).cast("long")).alias(f"{x}_{k}")
                                              for k in KINDS for x in "nm"])
    small = wide.where(F.greatest(*[F.col(f"n_{k}") for k in KINDS]) <= SMALL_SET).select("sequence_id")
    lists = coded.join(small, "sequence_id", "left_semi").groupBy("sequence_id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("value")))).alias(f"v_{k}") for k in KINDS])
    out = sequences.select("sequence_id", F.unix_seconds("start_time").alias("t")).join(wide, "sequence_id").join(lists, "sequence_id", "left")
    return values.sparkSession.read.schema(out.schema).parquet(kept_table(out, "sequence_profiles")), coded


def _similarity(shares: dict[str, Column]) -> Column:
    near = F.greatest(F.lit(0.0), 1 - F.abs(F.col("t_a") - F.col("t_b")) / float(DAY))
    # fixed values: weights of the similarity
    return shares["source"] * 0.3 + shares["target"] * 0.2 + shares["type"] * 0.3 + near * 0.2


def _share(kind: str, common: Column) -> Column:
    """Jaccard of one kind from the number of common values."""
    return common / (F.col(f"n_{kind}_a") + F.col(f"n_{kind}_b") - common)


def _block(left: DataFrame, right: DataFrame, within: int, parts: int, threshold: float, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Row pairs of one key (k1, k2), the earlier row first, at most ``within`` seconds apart, that can exceed the threshold.

    Time is cut into slots of ``within / parts`` seconds. Values whose bits the other side lacks are not common; kinds
    that are not listed share nothing. Other columns of both sides travel in ``own_a`` and ``own_b``, which the test of
    a pair does not open. Keys keep all shuffle partitions: the rows are few bytes, but the pairs made of them are many.
    """
    spread = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slot = F.floor(F.col("t") / (within // parts))
    key, facts = ["k1", "k2", "slot"], ["t", *[f"{x}_{k}" for k in KINDS for x in "nm"]]

    def side(rows, x):
        own = F.struct(*[c for c in rows.columns if c not in (*key, *facts)])
        return rows.select(*key, *[F.col(c).alias(f"{c}_{x}") for c in facts], own.alias(f"own_{x}"))

    a = side(left.withColumn("slot", F.explode(F.sequence(slot, slot + parts))), "a")
    b = side(right.withColumn("slot", slot).where("slot IS NOT NULL"), "b")
    a, b = _shares(a, b, key)
    key = [*key, "share"]

    def bound(k):
        lacks = lambda x, y: F.col(f"n_{k}_{x}") - F.bit_count(F.col(f"m_{k}_{x}").bitwiseAND(F.bitwise_not(f"m_{k}_{y}")))
        return _share(k, F.least(lacks("a", "b"), lacks("b", "a")))

    earlier = (F.col("t_a") < F.col("t_b")) | ((F.col("t_a") == F.col("t_b")) & (F.col("own_a.sequence_id") < F.col("own_b.sequence_id")))
    near = (F.col("t_b") - F.col("t_a")).between(0, within)
    likely = _similarity({k: bound(k) if k in kinds else F.lit(0.0) for k in KINDS}) > threshold - 1e-9
    return a.repartition(spread, *key).join(b.repartition(spread, *key), key).where(near & likely & earlier)


def _shares(a: DataFrame, b: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with a number ``share``: later rows of a key with more than ``SHARE`` of them are dealt to several shares,
    and its earlier rows are copied to each of them, so that no task makes all pairs of a frequent key."""
    sizes = b.groupBy(*key).agg(F.count("*").alias("n"))
    one = F.lit(0).cast("long")
    if (sizes.agg(F.max("n")).first()[0] or 0) <= SHARE:
        return a.withColumn("share", one), b.withColumn("share", one)
    many = sizes.where(F.col("n") > SHARE).select(*key, F.ceil(F.col("n") / SHARE).alias("shares"))
    many = b.sparkSession.read.schema(many.schema).parquet(kept_table(many, "frequent_keys"))
    shares = F.coalesce("shares", F.lit(1).cast("long"))
    a = a.join(many, key, "left").withColumn("share", F.explode(F.sequence(one, shares - 1)))
    b = b.join(many, key, "left").withColumn("share", F.pmod(F.xxhash64("own_b.sequence_id"), shares))
    return a.drop("shares"), b.drop("shares")


def _pair() -> list[Column]:
    ids = F.col("own_a.sequence_id"), F.col("own_b.sequence_id")
    return [F.least(*ids).alias("a"), F.greatest(*ids).alias("b")]


def _with_common(pairs: DataFrame) -> DataFrame:
    """Pairs with the common values of their sets.

    The values are made by a generator, as the optimizer moves no filter on its columns into the join: there, the sets
    of every pair of a key would be intersected before its bounds are looked at, by code too long to be compiled.
    """
    common = F.struct(*[F.array_intersect(f"own_a.v_{k}", f"own_b.v_{k}").alias(f"c_{k}") for k in KINDS])
    return pairs.select("*", F.inline(F.array(common)))


def _small_pairs(profiles: DataFrame, window: int, threshold: float) -> DataFrame:
    """Scored pairs of sequences whose sets are all small; a pair is made at its first common key only, so once.

    Pairs without a common source must be at most 12 h apart and share at least half of their targets and two
    thirds of their types, so they share a target and a type among the rarest of each (as many as a partner cannot
    all miss), and the rarest common ones are among them.
    """
    rare = {"target": F.slice("v_target", 1, (F.floor(F.col("n_target") / 2) + 1).cast("int")),
            "type": F.slice("v_type", 1, (F.floor(F.col("n_type") / 3) + 1).cast("int"))}
    zero = F.lit(0).cast("long").alias("k2")
    by_source = profiles.select("*", F.explode("v_source").alias("k1"), zero)
    by_both = profiles.select("*", F.explode(rare["target"]).alias("k1")).select("*", F.explode(rare["type"]).alias("k2"))
    # a common source counts inside the window, where the first block has found the pair
    apart = (F.size("c_source") == 0) | (F.col("t_b") - F.col("t_a") > window)
    others = ("target", "type") if window >= DAY // 2 else KINDS
    first = lambda k: F.try_element_at(f"c_{k}", F.lit(1))
    score = _similarity({k: _share(k, F.size(f"c_{k}")) for k in KINDS})
    one = _with_common(_block(by_source, by_source, window, 1, threshold)).where(F.col("k1") == first("source"))
    other = _with_common(_block(by_both, by_both, DAY // 2, 2, threshold, others)).where(
        (F.col("k1") == first("target")) & (F.col("k2") == first("type")) & apart)
    return one.unionByName(other).select(*_pair(), score.alias("similarity")).where(F.col("similarity") > threshold)


def _large_pairs(profiles: DataFrame, coded: DataFrame, window: int, threshold: float) -> DataFrame:
    """Scored pairs with a sequence of larger sets: candidates share a source or a target and a type; overlaps are joined in long form."""
    facts = profiles.select("sequence_id", "t", *[f"{x}_{k}" for k in KINDS for x in "nm"], F.col("v_source").isNull().alias("big"))
    known = coded.where("value IS NOT NULL")
    of = lambda kind, name: known.where(F.col("kind") == kind).select("sequence_id", F.col("value").alias(name))
    by_source = facts.join(of("source", "k1"), "sequence_id").withColumn("k2", F.lit(0).cast("long"))
    by_both = facts.join(of("target", "k1"), "sequence_id").join(of("type", "k2"), "sequence_id")
    blocks = [_block(keyed.where(x), keyed.where(y), within, parts, threshold)
              for keyed, within, parts in ((by_source, window, 1), (by_both, DAY // 2, 2))
              for x, y in (("big", "true"), ("NOT big", "big"))]
    pairs = blocks[0].select(*_pair())
    for more in blocks[1:]:
        pairs = pairs.unionByName(more.select(*_pair()))
    pairs = cut(pairs.distinct())
    out = pairs
    for x in "ab":
        out = out.join(facts.select(F.col("sequence_id").alias(x), F.col("t").alias(f"t_{x}")), x)
    for kind in KINDS:
        out = out.join(_overlaps(coded, kind, pairs), ["a", "b"], "left")
    score = _similarity({k: F.coalesce(F.col(k), F.lit(0.0)) for k in KINDS})
    return out.select("a", "b", score.alias("similarity")).where(F.col("similarity") > threshold)


def sequence_similarity(sequences: DataFrame, members: DataFrame, threshold: float = 0.6,
                        window_days: int = 7) -> DataFrame:
    """(a, b, similarity) of sequence pairs above the threshold (which must be at least 0.6).

    Starts are at most ``window_days`` apart. Either the pair shares a source, or targets, types and time must all
    agree so well (half the targets, two thirds of the types, 12 h) that it shares a (target, type) combination.
    Pairs are scored where they are made, from one row per sequence; only pairs above the threshold are moved.
    """
    if threshold < 0.6:
        raise ValueError("candidate blocking is exact for thresholds of at least 0.6")
    profiles, coded = sequence_profiles(sequences, sequence_values(members))
    small = profiles.where("v_source IS NOT NULL")
    out = _small_pairs(small, window_days * DAY, threshold)
    if profiles.where("v_source IS NULL").isEmpty():
        return out
    return out.unionByName(_large_pairs(profiles, coded, window_days * DAY, threshold))


def group_campaigns(similar: DataFrame, min_sequences: int = 3) -> DataFrame:
    """(sequence_id, campaign_id) for groups of at least ``min_sequences`` linked sequences."""
    groups = connected_components(similar, "a", "b")
    big = groups.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= min_sequences)
    return groups.join(big.select("component"), "component", "left_semi").select(
        F.col("node").alias("sequence_id"), F.col("component").alias("campaign_id"))


def target_consistency(campaigns: DataFrame, values: DataFrame) -> DataFrame:
    """(campaign_id, target_consistency): mean target overlap over all sequence pairs of a campaign.

    Sequences with the same target set are counted once with their multiplicity;
    pairs without a common target contribute nothing and are never formed.
    """
    mine = values.where("kind = 'target'").join(campaigns, "sequence_id")
    h = F.xxhash64("value")
    marked = mine.groupBy("campaign_id", "sequence_id").agg(
        F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"))
    sets = marked.groupBy("campaign_id", "n", "x", "s").agg(F.count("*").alias("m"), F.min("sequence_id").alias("rep"))
    same = sets.groupBy("campaign_id").agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("j"),
                                           F.sum("m").alias("total"))
    reps = mine.join(sets.select(F.col("rep").alias("sequence_id"), "n", "m"), "sequence_id")
    left = reps.select("campaign_id", "value", F.col("sequence_id").alias("a"), F.col("n").alias("na"), F.col("m").alias("ma"))
    right = reps.select("campaign_id", "value", F.col("sequence_id").alias("b"), F.col("n").alias("nb"), F.col("m").alias("mb"))
    common = left.join(right, ["campaign_id", "value"]).where("a < b").groupBy(
        "campaign_id", "a", "b", "na", "nb", "ma", "mb").agg(F.count("*").alias("i"))
    cross = common.groupBy("campaign_id").agg(F.sum(
        F.col("i") / (F.col("na") + F.col("nb") - F.col("i")) * F.col("ma") * F.col("mb")).alias("jc"))
    pairs = F.col("total") * (F.col("total") - 1) / 2
    return same.join(cross, "campaign_id", "left").select("campaign_id", F.when(
        pairs > 0, (F.col("j") + F.coalesce("jc", F.lit(0.0))) / pairs).otherwise(0.0).alias("target_consistency"))


def time_consistency(campaigns: DataFrame, sequences: DataFrame) -> DataFrame:
    """(campaign_id, time_consistency): 1 for evenly spaced sequences, falling with the spread of the gaps.

    The previous sequence is found inside half-day slices with a carry between them.
    """
    mine = campaigns.join(sequences.select("sequence_id", "start_time", "end_time"), "sequence_id")
    before = running(mine, ["campaign_id"], ["start_time", "sequence_id"], time_bucket("start_time", DAY // 2),
                     {"_prev": ("last", F.col("end_time"))}, exclusive=True)
    gap = (F.unix_micros("start_time") - F.unix_micros("_prev")) / 1e6
    stats = before.withColumn("gap", gap).groupBy("campaign_id").agg(
        F.count("*").alias("n"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("std"))
    score = F.greatest(F.lit(0.0), 1 - F.col("std") / F.col("mean") / 2)
    return stats.select("campaign_id", F.when((F.col("n") < 2) | (F.col("mean") == 0), 1.0).otherwise(score)
                        .alias("time_consistency"))


def campaign_facts(campaigns: DataFrame, sequences: DataFrame) -> DataFrame:
    """Span, sizes, mean progression and highest severity per campaign."""
    mine = campaigns.join(sequences.drop("campaign_id"), "sequence_id")
    return mine.groupBy("campaign_id").agg(
        F.count("*").alias("sequence_count"), F.min("start_time").alias("start_time"),
        F.max_by("end_time", F.struct("start_time", "sequence_id")).alias("end_time"),
        F.sum("event_count").alias("total_events"), F.avg("progression_score").alias("avg_progression_score"),
        F.max(severity_index("severity")).alias("_sev"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("attack_types")))).alias("attack_types")).withColumn(
        "max_severity", F.element_at(F.array(*map(F.lit, K.SEVERITY_ORDER)), F.col("_sev") + 1)).drop("_sev")


def campaign_confidence(campaigns: DataFrame, sequences: DataFrame, members: DataFrame) -> DataFrame:
    facts = campaign_facts(campaigns, sequences)
    # fixed values: weights and caps of the confidence
    score = (F.least(F.col("sequence_count") / 10, F.lit(0.3)) + F.col("avg_progression_score") * 0.25
             + F.col("time_consistency") * 0.2 + F.col("target_consistency") * 0.15
             + F.least(F.size("attack_types") / 5, F.lit(1.0)) * 0.1)
    return (facts.join(time_consistency(campaigns, sequences), "campaign_id")
            .join(target_consistency(campaigns, sequence_values(members)), "campaign_id")
            .withColumn("confidence_score", F.least(score, F.lit(1.0))))


def campaign_name(types: Column, start: Column) -> Column:
    n = F.size(types)
    base = cases([(n == 1, F.concat(F.element_at(types, 1), F.lit(" Campaign"))),
                  (n <= 3, F.concat(F.lit("Multi-Vector Campaign ("), F.array_join(types, ", "), F.lit(")")))],
                 F.format_string("Complex Attack Campaign (%d vectors)", n))
    return F.concat(base, F.lit(" - "), F.date_format(start, "yyyyMMdd"))


def attribution(types: Column) -> Column:
    """Best matching actor whose share of known patterns exceeds 0.6; the first one wins ties."""
    patterns = F.transform(types, lambda t: F.regexp_replace(F.lower(t), " ", "_"))
    best = F.lit(None).cast("struct<score:double,name:string>")
    for actor, known in K.ACTOR_PATTERNS.items():
        score = F.size(F.array_intersect(patterns, F.array(*map(F.lit, known)))) / float(len(known))
        better = (score > 0.6) & (best.isNull() | (score > best["score"]))
        best = F.when(better, F.struct(score.alias("score"), F.lit(actor).alias("name"))).otherwise(best)
    return F.when(best.isNotNull(), F.format_string("%s (confidence: %.2f)", best["name"], best["score"]))


def mitre_mapping(types: Column) -> tuple[Column, Column]:
    """Distinct tactic and technique ids of the attack types."""
    def mapped(i):
        table = {t: ids[i] for t, ids in K.MITRE.items()}
        return F.array_sort(F.array_distinct(F.array_compact(F.transform(types, lambda t: lookup(t, table)))))
    return mapped(0), mapped(1)


def campaign_iocs(campaigns: DataFrame, members: DataFrame) -> DataFrame:
    """(campaign_id, indicator) in long form: addresses and ports of a large campaign do not fit one array."""
    values = F.explode(F.array(
        F.concat(F.lit("ip:"), "source_ip"), F.concat(F.lit("port:"), F.col("source_port").cast("string")),
        F.concat(F.lit("protocol:"), "protocol"), F.concat(F.lit("attack_type:"), "attack_type"))).alias("indicator")
    return members.drop("campaign_id").join(campaigns, "sequence_id").select("campaign_id", values).distinct()


def campaign_addresses(campaigns: DataFrame, members: DataFrame) -> DataFrame:
    """(campaign_id, kind, value) of all sources and targets of a campaign."""
    return sequence_values(members).where("kind <> 'type'").join(campaigns, "sequence_id").select(
        "campaign_id", "kind", "value").distinct()


def build_campaigns(campaigns: DataFrame, sequences: DataFrame, members: DataFrame) -> DataFrame:
    """One row per campaign; address and indicator lists stay in their long tables."""
    base = campaign_confidence(campaigns, sequences, members)
    sizes = campaign_addresses(campaigns, members).groupBy("campaign_id").agg(
        count_if(F.col("kind") == "source").alias("source_count"), count_if(F.col("kind") == "target").alias("target_count"))
    iocs = campaign_iocs(campaigns, members).groupBy("campaign_id").agg(F.count("*").alias("indicator_count"))
    types = F.col("attack_types")
    tactics, techniques = mitre_mapping(types)
    return base.join(sizes, "campaign_id").join(iocs, "campaign_id").withColumns({
        "name": campaign_name(types, F.col("start_time")), "attribution": attribution(types),
        "tactics": tactics, "techniques": techniques,
        "duration_seconds": F.unix_seconds("end_time") - F.unix_seconds("start_time")})


# --- context and priorities ---------------------------------------------------------------------

def threat_context(events: DataFrame, sequences: DataFrame, members: DataFrame) -> DataFrame:
    """What is known per source: first type, span, worst sequence, confidence of the last event plus a bonus."""
    last = F.struct("ts", "event_id")
    per = events.groupBy("source_ip").agg(
        F.min_by("attack_type", last).alias("threat_type"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.max_by("confidence_score", last).alias("last_confidence"))
    involved = sequence_values(members).where("kind = 'source'").join(
        sequences.select("sequence_id", severity_index("severity").alias("s")), "sequence_id").groupBy(
        F.col("value").alias("source_ip")).agg(F.max("s").alias("s"), F.count("*").alias("n"))
    worst = F.element_at(F.array(*map(F.lit, K.SEVERITY_ORDER)), F.coalesce("s", F.lit(0)) + 1)
    bonus = F.least(F.coalesce("n", F.lit(0)) * 0.1, F.lit(0.3))
    return per.join(involved, "source_ip", "left").select(
        F.concat(F.lit("threat_"), md5_id(["source_ip"], 8)).alias("threat_id"), "source_ip", "threat_type",
        worst.alias("severity"), F.least(F.col("last_confidence") + bonus, F.lit(1.0)).alias("confidence"),
        "first_seen", "last_seen")


def prioritize_alerts(alerts: DataFrame, context: DataFrame, sequences: DataFrame, members: DataFrame,
                      campaigns: DataFrame, campaign_table: DataFrame, now: datetime, id_col: str = "record_id",
                      recent_campaigns: int = 10) -> DataFrame:
    """Alerts with a priority score, most urgent first.

    Factors are looked up per source address: its threat context, the newest
    sequence of the last day and the newest of the latest campaigns it takes part in.
    """
    sources = sequence_values(members).where("kind = 'source'").select("sequence_id", F.col("value").alias("source_ip"))
    recent = sequences.where(F.col("start_time") >= F.lit(now - timedelta(hours=24)))
    involved = sources.join(recent.select("sequence_id", "start_time", "progression_score"), "sequence_id").groupBy(
        "source_ip").agg(F.max_by("progression_score", F.struct("start_time", "sequence_id")).alias("sequence_score"))
    latest = campaign_table.orderBy(F.desc("start_time"), F.desc("campaign_id")).limit(recent_campaigns)
    taking_part = (sources.join(campaigns, "sequence_id").join(
        latest.select("campaign_id", "start_time", "confidence_score"), "campaign_id").groupBy("source_ip").agg(
        F.max_by("confidence_score", F.struct("start_time", "campaign_id")).alias("campaign_score")))
    joined = (alerts.join(context.select("source_ip", F.col("confidence").alias("context_score")), "source_ip", "left")
              .join(involved, "source_ip", "left").join(taking_part, "source_ip", "left"))
    age = (F.unix_micros(F.lit(now)) - F.unix_micros("ts")) / 1e6
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    weight = lookup(F.upper("severity"), K.SEVERITY_WEIGHTS, K.DEFAULT_SEVERITY_WEIGHT)
    # fixed values: weights of the priority
    score = (F.col("confidence_score") * 0.25 + weight * 0.2 + zero("context_score") * 0.2 + zero("sequence_score") * 0.15
             + zero("campaign_score") * 0.15 + F.greatest(F.lit(0.1), 1 - age / 3600) * 0.05)
    return joined.withColumn("priority_score", F.least(score, F.lit(1.0))).orderBy(F.desc("priority_score"), id_col)


def correlation_stats(events: DataFrame, sequences: DataFrame, campaigns: DataFrame, now: datetime,
                      rules=DEFAULT_RULES) -> DataFrame:
    """(item, n): events, sequences and campaigns in total and in the last day, active rules."""
    since = F.lit(now - timedelta(hours=24))

    def pair(df, name, ts):
        both = df.agg(F.count("*").alias("total"), count_if(F.col(ts) >= since).alias("recent"))
        return both.select(F.explode(F.array(
            F.struct(F.lit(f"total_{name}").alias("item"), F.col("total").alias("n")),
            F.struct(F.lit(f"recent_{name}_24h").alias("item"), F.col("recent").alias("n")))).alias("e")).select("e.*")

    active = events.sparkSession.range(1).select(
        F.lit("active_rules").alias("item"), F.lit(sum(r.enabled for r in rules)).cast("long").alias("n"))
    return (pair(events, "events", "ts").unionByName(pair(sequences, "sequences", "start_time"))
            .unionByName(pair(campaigns, "campaigns", "start_time")).unionByName(active))


def newest(df: DataFrame, id_col: str, limit: int = 50, ts: str = "start_time") -> DataFrame:
    """Latest sequences or campaigns."""
    return df.orderBy(F.desc(ts), F.desc(id_col)).limit(limit)
