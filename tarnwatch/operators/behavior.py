"""Behaviour profiles, baselines, anomalies and time patterns per entity."""

from __future__ import annotations

import pickle
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.columns import cases, count_if, safe_corr
from tarnwatch.functions.text import md5_id
from tarnwatch.operators.features import behavior_vector, built_in_features
from tarnwatch.operators.scan import map_sorted_groups, running, time_bucket
from tarnwatch.session import ensure_checkpoint_dir

# fixed values: analysis settings
MIN_OBSERVATIONS = 100
Z_LIMIT = 2.0
CONFIDENCE_THRESHOLD = 0.7
MIN_PATTERN_ROWS = 24


def observations(traffic: DataFrame, entity: str = "source_ip", extra: str | None = None) -> DataFrame:
    """Long form (entity_id, ts, record_id, feature, value): one row per feature of a record."""
    return traffic.select(F.col(entity).alias("entity_id"), "ts", "record_id",
                          F.explode(behavior_vector(extra)).alias("feature", "value"))


PARTS = ["count", "sum", "sum_squares", "min", "max"]


def profile_parts(obs: DataFrame) -> DataFrame:
    """Mergeable state per (entity, feature)."""
    v = F.col("value")
    return obs.groupBy("entity_id", "feature").agg(
        F.count(v).alias("count"), F.sum(v).alias("sum"), F.sum(v * v).alias("sum_squares"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.max("ts").alias("last_updated"))


def _built_in_parts(traffic: DataFrame, entity: str, keep: Column | None, recent: Column | None) -> DataFrame:
    """Same state for the built-in features, aggregated side by side: no row is repeated per feature."""
    aggs, entries = [], []
    for i, (name, value) in enumerate(built_in_features().items()):
        v = value if keep is None else F.when(keep, value)
        named = {"count": F.count(v), "sum": F.sum(v), "sum_squares": F.sum(v * v), "min": F.min(v), "max": F.max(v)}
        if recent is not None:
            named["observed_value"] = F.avg(F.when(recent, value))
        aggs += [agg.alias(f"{stat}{i}") for stat, agg in named.items()]
        entries.append(F.struct(F.lit(name).alias("feature"), *[F.col(f"{stat}{i}").alias(stat) for stat in named]))
    wide = traffic.groupBy(F.col(entity).alias("entity_id")).agg(F.max("ts").alias("last_updated"), *aggs)
    return wide.select("entity_id", "last_updated", F.explode(F.array(*entries)).alias("e")).select(
        "entity_id", "e.*", "last_updated")


def merge_parts(parts: list[DataFrame]) -> DataFrame:
    """Combine partial profiles, e.g. the stored one with the one of a new batch."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("entity_id", "feature").agg(
        F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.sum("sum_squares").alias("sum_squares"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.max("last_updated").alias("last_updated"))


def finish(parts: DataFrame) -> DataFrame:
    """Mean and sample deviation from the mergeable state."""
    n, s, q = F.col("count"), F.col("sum"), F.col("sum_squares")
    variance = F.greatest((q - s * s / n) / F.nullif(n - 1, F.lit(0)), F.lit(0.0))
    return parts.withColumn("mean", s / n).withColumn(
        "std", F.when(n > 1, F.sqrt(variance)).otherwise(0.0))


def behavior_profiles(traffic: DataFrame, entity: str = "source_ip", extra: str | None = None) -> DataFrame:
    if extra is None:
        return finish(_built_in_parts(traffic, entity, None, None))
    return finish(profile_parts(observations(traffic, entity, extra)))


def baselines(profiles: DataFrame, min_obs: int = MIN_OBSERVATIONS, manual: list[str] | None = None) -> DataFrame:
    """Observation count, confidence and whether the baseline stands, per entity."""
    per = profiles.groupBy("entity_id").agg(F.max("count").alias("observation_count"),
                                            F.max("last_updated").alias("last_updated"))
    forced = F.col("entity_id").isin(*manual) if manual else F.lit(False)
    return per.withColumn("confidence_score", F.when(forced, 1.0).otherwise(
        F.least(F.col("observation_count") / float(min_obs), F.lit(1.0)))).withColumn(
        "baseline_established", forced | (F.col("observation_count") >= min_obs))


def z_severity(z: Column) -> Column:
    return cases([(z > 4.0, "critical"), (z > 3.0, "high"), (z > 2.0, "medium")], "low")


def ml_severity(score: Column) -> Column:
    return cases([(score > 0.8, "critical"), (score > 0.6, "high"), (score > 0.4, "medium")], "low")


def recommendation(severity: Column, kind: str) -> Column:
    rows = [(severity == s, F.lit(text)) for (s, k), text in K.ANOMALY_RECOMMENDATIONS.items() if k == kind]
    return cases(rows, F.lit(K.DEFAULT_ANOMALY_RECOMMENDATION))


def record_alerts(obs: DataFrame, stored: DataFrame | None = None, min_obs: int = MIN_OBSERVATIONS,
                  bucket_seconds: int = 60) -> DataFrame:
    """Values more than two deviations away from the profile of everything before them.

    The profile of a value is the stored one plus the values before it in ``obs``, by (ts, record_id). Running sums are
    two-level, so a busy entity is spread over as many tasks as it has buckets. Values that are NULL raise nothing and
    change nothing; a profile of fewer than ``min_obs`` values or without spread raises nothing.
    """
    v = F.col("value")
    sums = {"count": ("count", v), "sum": ("sum", v), "sum_squares": ("sum", v * v)}
    seen = running(obs, ["entity_id", "feature"], ["ts", "record_id"], time_bucket("ts", bucket_seconds), sums,
                   exclusive=True, group=1440)
    if stored is not None:
        known = stored.select("entity_id", "feature", *[F.col(c).alias(f"_s_{c}") for c in sums])
        seen = seen.join(known, ["entity_id", "feature"], "left").withColumns(
            {c: F.coalesce(c, F.lit(0)) + F.coalesce(f"_s_{c}", F.lit(0)) for c in sums})
    n, s, q = F.col("count"), F.col("sum"), F.col("sum_squares")
    # what is left of equal values by rounding is no spread
    variance = F.when(q - s * s / n > q * 1e-12, (q - s * s / n) / (n - 1))
    return (seen.where((n >= max(min_obs, 2)) & v.isNotNull())
            .withColumn("baseline_value", s / n).withColumn("z_score", F.abs(v - F.col("baseline_value")) / F.sqrt(variance))
            .where(F.col("z_score") > Z_LIMIT)
            .select("record_id", "ts", "entity_id", "feature", F.lit("statistical_deviation").alias("anomaly_type"),
                    z_severity(F.col("z_score")).alias("severity"), F.least(F.col("z_score") / 5.0, F.lit(1.0)).alias("anomaly_score"),
                    "baseline_value", v.alias("observed_value"), "z_score", n.alias("profile_count")))


def zscore_anomalies(traffic: DataFrame, now: datetime, hours: float = 24, min_obs: int = MIN_OBSERVATIONS,
                     entity: str = "source_ip", exclude_recent: bool = False, extra: str | None = None) -> DataFrame:
    """Features whose recent mean left the baseline by more than two deviations.

    One aggregation yields the profile and the recent sums side by side.
    """
    recent = F.col("ts") >= F.lit(now - timedelta(hours=hours))
    if extra is None:
        state = _built_in_parts(traffic, entity, ~recent if exclude_recent else None, recent)
    else:
        v = F.col("value")
        base = F.when(~recent, v) if exclude_recent else v
        state = observations(traffic, entity, extra).groupBy("entity_id", "feature").agg(
            F.count(base).alias("count"), F.sum(base).alias("sum"), F.sum(base * base).alias("sum_squares"),
            F.avg(F.when(recent, v)).alias("observed_value"))
    z = F.try_divide(F.abs(F.col("observed_value") - F.col("mean")), F.col("std"))
    hits = (finish(state).where((F.col("count") >= min_obs) & (F.col("std") > 0) & F.col("observed_value").isNotNull())
            .withColumn("z_score", z).where(F.col("z_score") > Z_LIMIT)
            .withColumn("severity", z_severity(F.col("z_score"))))
    return hits.select(
        md5_id(["entity_id", "feature", F.lit(now.isoformat())], 16, "_").alias("anomaly_id"), "entity_id", "feature",
        F.lit("statistical_deviation").alias("anomaly_type"), "severity",
        F.least(F.col("z_score") / 5.0, F.lit(1.0)).alias("anomaly_score"), F.col("mean").alias("baseline_value"),
        "observed_value", "z_score",
        F.format_string("Statistical anomaly in %s: observed %.2f vs baseline %.2f (z-score: %.2f)",
                        "feature", "observed_value", "mean", "z_score").alias("description"),
        recommendation(F.col("severity"), "statistical_deviation").alias("recommended_action"))


# --- isolation forest --------------------------------------------------------------

TREES, SUBSAMPLE, CONTAMINATION = 100, 256, 0.1
MAX_ENTITY_ROWS = 50_000
# rows that a forest is grown on, as many as its trees draw
POOL = TREES * SUBSAMPLE
SCORE_BINS = 65_536


def _average_path(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2 * (np.log(n[big] - 1) + 0.5772156649015329) - 2 * (n[big] - 1) / n[big]
    return out


def _grow(samples: np.ndarray, height: int, rng: np.random.Generator):
    """Random trees over (tree, row, feature) samples, all trees level by level.

    Nodes are numbered as in a heap. Returns per (tree, node): split flag,
    feature, cut and number of sample rows.
    """
    trees, rows, features = samples.shape
    slots = 2 ** (height + 1)
    flat = samples.reshape(-1, features)
    tree = np.repeat(np.arange(trees), rows)
    node = np.ones(trees * rows, dtype=np.int64)
    split = np.zeros((trees, slots), dtype=bool)
    feature = np.zeros((trees, slots), dtype=np.int64)
    cut = np.zeros((trees, slots))
    for _ in range(height):
        key = tree * slots + node
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(key[order]) > 0])
        lows = np.minimum.reduceat(flat[order], starts, axis=0)
        spread = np.maximum.reduceat(flat[order], starts, axis=0) - lows
        pick = np.argmax(rng.random(spread.shape) * (spread > 0), axis=1)
        at = np.arange(len(starts))
        value = lows[at, pick] + rng.random(len(starts)) * spread[at, pick]
        t, n = np.divmod(key[order][starts], slots)
        split[t, n], feature[t, n], cut[t, n] = spread[at, pick] > 0, pick, value
        right = flat[np.arange(len(flat)), feature[tree, node]] >= cut[tree, node]
        node = np.where(split[tree, node], 2 * node + right, node)
    size = np.bincount(tree * slots + node, minlength=trees * slots).reshape(trees, slots)
    return split, feature, cut, size


def grow_forest(x: np.ndarray, seed: int) -> tuple:
    """Trees on subsamples of the rows. Cuts lie between a subsample's ends, so columns need no common scale."""
    rng = np.random.default_rng(seed)
    size = min(SUBSAMPLE, len(x))
    height = int(np.ceil(np.log2(max(size, 2))))
    drawn = np.stack([rng.choice(len(x), size, replace=False) for _ in range(TREES)])
    return (size, height, *_grow(x[drawn], height, rng))


def forest_scores(forest: tuple, x: np.ndarray, chunk: int = 2_000) -> np.ndarray:
    """Anomaly score in (0, 1) of every row; above about one half is suspicious."""
    size, height, split, feature, cut, members = forest
    extra = _average_path(members)
    tree = np.arange(TREES)[:, None]
    scores = []
    for lo in range(0, len(x), chunk):
        part = x[lo:lo + chunk]
        row = np.arange(len(part))[None, :]
        node = np.ones((TREES, len(part)), dtype=np.int64)
        for _ in range(height):
            right = part[row, feature[tree, node]] >= cut[tree, node]
            node = np.where(split[tree, node], 2 * node + right, node)
        depth = np.floor(np.log2(node)) + extra[tree, node]
        scores.append(2.0 ** (-depth.mean(axis=0) / max(_average_path(np.array([size]))[0], 1e-9)))
    return np.concatenate(scores)


def isolation_scores(x: np.ndarray, seed: int) -> np.ndarray:
    return forest_scores(grow_forest(x, seed), x)


def score_borders(scored: DataFrame) -> DataFrame:
    """entity_id, _border: the exact, interpolated quantile of an entity's scores.

    Scores are counted in fine bins first; only those of the bins that hold the two ranks are looked at one by one.
    """
    by_bin = Window.partitionBy("entity_id").orderBy("_bin")
    every = Window.partitionBy("entity_id")
    binned = scored.withColumn("_bin", F.floor(F.col("_score") * SCORE_BINS))
    at = (1 - CONTAMINATION) * (F.col("_n") - 1)
    bins = binned.groupBy("entity_id", "_bin").agg(F.count("*").alias("_c")).withColumns(
        {"_to": F.sum("_c").over(by_bin), "_n": F.sum("_c").over(every)}).withColumns({"_from": F.col("_to") - F.col("_c"), "_at": at})
    holds = lambda rank: (F.col("_from") <= rank) & (rank < F.col("_to"))
    wanted = bins.where(holds(F.floor("_at")) | holds(F.ceil("_at"))).select("entity_id", "_bin", "_from", "_at")
    by_score = Window.partitionBy("entity_id", "_bin").orderBy("_score")
    values = binned.join(F.broadcast(wanted), ["entity_id", "_bin"]).groupBy("entity_id", "_bin", "_from", "_at", "_score").agg(F.count("*").alias("_c"))
    values = values.withColumn("_to", F.col("_from") + F.sum("_c").over(by_score)).withColumn("_from", F.col("_to") - F.col("_c"))
    ends = values.groupBy("entity_id", "_at").agg(F.max(F.when(holds(F.floor("_at")), F.col("_score"))).alias("_low"),
                                                  F.max(F.when(holds(F.ceil("_at")), F.col("_score"))).alias("_high"))
    return ends.select("entity_id", (F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at"))).alias("_border"))


def isolation_forest_anomalies(traffic: DataFrame, now: datetime, hours: float = 24, entity: str = "source_ip",
                               min_rows: int = 10, seed: int = 42) -> DataFrame:
    """Rows of an entity that isolation trees separate early.

    An entity has one forest, grown on about ``POOL`` of its rows drawn by hash (all rows if it has no more, as many
    as its trees draw anyway), and one border, the exact quantile of the scores of all its rows. Entities with more
    recent rows than one task should hold are scored in several tasks with their forest; the result is the same.
    """
    names = ["packet_size", "duration", "destination_port", "source_port", "protocol_numeric", "hour_of_day",
             "day_of_week", "flags_count"]
    recent = traffic.where(F.col("ts") >= F.lit(now - timedelta(hours=hours)))
    vector = behavior_vector(None)
    rows = recent.select(F.col(entity).alias("entity_id"), "ts", "record_id",
                         *[F.element_at(vector, F.lit(n)).alias(n) for n in names])
    sizes = recent.groupBy(F.col(entity).alias("entity_id")).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_rows)
    draw = F.pmod(F.xxhash64("record_id", "ts", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sized = rows.join(sizes, "entity_id").withColumn("_drawn", (F.col("_n") <= POOL) | (draw < POOL / F.col("_n")))

    def grown(part: pd.DataFrame) -> tuple:
        return grow_forest(part.loc[part["_drawn"], names].to_numpy(dtype=float), seed)

    def detect(frame: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        out = []
        for g in np.unique(group):
            part = frame[group == g]
            scores = forest_scores(grown(part), part[names].to_numpy(dtype=float))
            border = np.quantile(scores, 1 - CONTAMINATION)
            hit = scores > border
            found = part.loc[hit, ["entity_id", "ts", "record_id"]].copy()
            found["anomaly_score"] = np.minimum(np.abs(scores[hit] - border), 1.0)
            out.append(found)
        return pd.concat(out)

    fields = "entity_id string, ts timestamp, record_id long"
    found = map_sorted_groups(sized.where(F.col("_n") <= MAX_ENTITY_ROWS).drop("_n"), ["entity_id"], ["record_id"], detect,
                              f"{fields}, anomaly_score double", spread=True)
    if sizes.where(F.col("_n") > MAX_ENTITY_ROWS).limit(1).count():
        large = sized.where(F.col("_n") > MAX_ENTITY_ROWS)
        shares = F.ceil(F.col("_n") / MAX_ENTITY_ROWS).cast("int")

        def fit(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["record_id", "ts"], kind="stable")
            return pd.DataFrame({"entity_id": part["entity_id"].iloc[:1], "_shares": part["_shares"].iloc[:1], "_forest": [pickle.dumps(grown(part))]})

        def score(part: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
            out = part[["entity_id", "ts", "record_id"]].copy()
            out["_score"] = forest_scores(pickle.loads(forest["_forest"].iloc[0]), part[names].to_numpy(dtype=float)) if len(part) else 0.0
            return out

        forests = large.where("_drawn").withColumn("_shares", shares).drop("_n").groupBy("entity_id").applyInPandas(
            fit, "entity_id string, _shares int, _forest binary")
        forests = forests.select("entity_id", "_forest", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_share"))
        placed = large.withColumn("_share", F.pmod(F.xxhash64("record_id", "ts"), shares).cast("int")).drop("_n", "_drawn")
        ensure_checkpoint_dir(traffic.sparkSession)
        scored = placed.groupBy("entity_id", "_share").cogroup(forests.groupBy("entity_id", "_share")).applyInPandas(
            score, f"{fields}, _score double").checkpoint()
        over = scored.join(F.broadcast(score_borders(scored)), "entity_id").where("_score > _border")
        found = found.unionByName(over.select("entity_id", "ts", "record_id", F.least(F.col("_score") - F.col("_border"), F.lit(1.0)).alias("anomaly_score")))
    severity = ml_severity(F.col("anomaly_score"))
    return found.select(
        "entity_id", "ts", "record_id", F.lit("ml_anomaly").alias("anomaly_type"), severity.alias("severity"),
        "anomaly_score", F.format_string("Machine learning anomaly detected (score: %.3f)", "anomaly_score")
        .alias("description"), recommendation(severity, "ml_anomaly").alias("recommended_action"))


# --- time patterns -------------------------------------------------------------------

def bucket_means(traffic: DataFrame, kind: str, now: datetime, days: float = 7, entity: str = "source_ip",
                 min_rows: int = MIN_PATTERN_ROWS) -> DataFrame:
    """(entity_id, idx, bucket, mean, std, count): mean packet size per hour of day, date, or weekday.

    Hours and weekdays are zero-filled; dates only exist where there was traffic.
    """
    scope = traffic.where(F.col("ts").between(F.lit(now - timedelta(days=days)), F.lit(now)))
    bucket = {"hourly": F.hour("ts"), "weekly": F.weekday("ts"), "daily": F.unix_date(F.to_date("ts"))}[kind]
    value = F.col("packet_size").cast("double")
    grouped = scope.groupBy(F.col(entity).alias("entity_id"), bucket.alias("bucket")).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("count"))
    # at most one row per bucket and entity from here on
    per_entity = Window.partitionBy("entity_id")
    grouped = grouped.withColumn("_rows", F.sum("count").over(per_entity)).where(F.col("_rows") >= min_rows)
    if kind == "daily":
        idx = F.row_number().over(per_entity.orderBy("bucket")) - 1
        return grouped.withColumn("idx", idx).select("entity_id", "idx", "bucket", "mean", "std", "count")
    slots = grouped.select("entity_id").distinct().withColumn(
        "bucket", F.explode(F.sequence(F.lit(0), F.lit({"hourly": 23, "weekly": 6}[kind]))))
    filled = slots.join(grouped, ["entity_id", "bucket"], "left")
    return filled.select("entity_id", F.col("bucket").alias("idx"), "bucket",
                         *[F.coalesce(c, F.lit(0)).alias(c) for c in ("mean", "std", "count")])


def traffic_patterns(traffic: DataFrame, kind: str, now: datetime, days: float = 7, entity: str = "source_ip",
                     min_rows: int = MIN_PATTERN_ROWS) -> DataFrame:
    """One pattern row per entity: statistics over bucket means, peak and low bucket, season and trend."""
    series = bucket_means(traffic, kind, now, days, entity, min_rows)
    order = Window.partitionBy("entity_id").orderBy("idx")
    stats = series.withColumn("_lag", F.lag("mean").over(order)).groupBy("entity_id").agg(
        F.count("*").alias("points"), F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("std"),
        F.min("mean").alias("min"), F.max("mean").alias("max"),
        F.max_by("bucket", F.struct(F.col("mean").alias("a"), (-F.col("idx")).alias("b"))).alias("peak"),
        F.min_by("bucket", F.struct(F.col("mean").alias("a"), F.col("idx").alias("b"))).alias("low"),
        safe_corr("mean", "_lag").alias("lag_correlation"),
        F.try_divide(F.covar_pop("mean", "idx"), F.var_pop("idx")).alias("slope"))
    return _with_trend(stats).withColumn("pattern_type", F.lit(kind))


def _with_trend(stats: DataFrame) -> DataFrame:
    slope = F.coalesce("slope", F.lit(0.0))
    return stats.withColumn("slope", slope).withColumn(
        "seasonality", (F.col("points") >= 4) & (F.col("std") > 0)
        & F.coalesce(F.abs("lag_correlation") > 0.5, F.lit(False))).withColumn(
        "trend", cases([(F.col("points") < 3, "stable"), (F.col("slope") > 0.1, "increasing"),
                        (F.col("slope") < -0.1, "decreasing")], "stable")).drop("lag_correlation")


def all_patterns(traffic: DataFrame, now: datetime, days: float = 7, entity: str = "source_ip") -> DataFrame:
    out = traffic_patterns(traffic, "hourly", now, days, entity)
    for kind in ("daily", "weekly"):
        out = out.unionByName(traffic_patterns(traffic, kind, now, days, entity))
    return out


def pattern_anomalies(patterns: DataFrame, slope_limit: float = 10.0) -> DataFrame:
    """Highly variable patterns and (daily) patterns that rise fast."""
    rising = (F.col("pattern_type") == "daily") & (F.col("trend") == "increasing") & (F.col("slope") > slope_limit)
    return patterns.where((F.col("std") > F.col("mean") * 2) | rising).select(
        "entity_id", "pattern_type", F.lit("pattern_deviation").alias("anomaly_type"),
        F.lit("medium").alias("severity"), F.lit(0.7).alias("anomaly_score"),
        F.concat(F.lit("Pattern anomaly detected in "), "pattern_type", F.lit(" traffic pattern")).alias("description"),
        recommendation(F.lit("medium"), "pattern_deviation").alias("recommended_action"))


# --- summaries -------------------------------------------------------------------------

def behavior_summary(base: DataFrame, anomalies: DataFrame, patterns: DataFrame) -> DataFrame:
    """Baseline facts, anomaly counts by severity and pattern facts per entity."""
    bad = anomalies.groupBy("entity_id").agg(
        F.count("*").alias("anomalies"), count_if(F.col("severity") == "critical").alias("critical"),
        count_if(F.col("severity") == "high").alias("high"))
    shape = patterns.groupBy("entity_id").agg(
        F.array_sort(F.collect_list(F.struct("pattern_type", "trend", "seasonality"))).alias("patterns"),
        F.max(F.col("trend") == "increasing").alias("rising"), F.max("seasonality").alias("seasonal"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("anomalies", "critical", "high")}
    no = {c: F.coalesce(c, F.lit(False)) for c in ("rising", "seasonal")}
    return base.join(bad, "entity_id", "left").join(shape, "entity_id", "left").withColumns({**zero, **no})


def behavior_recommendations(summary: DataFrame, min_obs: int = MIN_OBSERVATIONS,
                             confidence: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """(entity_id, recommendations) from the summary; an entity without a profile has a NULL count."""
    n = F.col("observation_count")
    profile = cases([
        (n.isNull(), F.lit("No behavioral profile found. Start collecting data to establish baseline.")),
        (~F.col("baseline_established"), F.format_string("Baseline not established. Need %d more observations.",
                                                         F.lit(min_obs).cast("long") - n)),
        (F.col("confidence_score") < confidence, F.format_string(
            "Low confidence score (%.2f). Increase observation period.", "confidence_score"))],
        F.lit(None).cast("string"))
    return summary.select("entity_id", F.array_compact(F.array(
        profile,
        F.when(F.col("critical") > 0, F.format_string(
            "Critical anomalies detected (%d). Immediate investigation required.", "critical")),
        F.when(F.col("high") > 0, F.format_string(
            "High severity anomalies detected (%d). Review within 1 hour.", "high")),
        F.when(F.col("rising"), F.lit("Increasing traffic trends detected. Monitor for capacity issues.")),
        F.when(F.col("seasonal"), F.lit("Seasonal patterns detected. Consider time-based alerting rules.")),
    )).alias("recommendations"))

