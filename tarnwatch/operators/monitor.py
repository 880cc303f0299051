"""Model monitoring: performance, drift, counters, rates and quotas."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.functions.columns import cases, count_if, ratio
from tarnwatch.operators.alerts import keep_spaced
from tarnwatch.operators.scan import running


def prediction_performance(log: DataFrame, now: datetime | None = None, hours: float | None = None,
                           keys=("model_version",)) -> DataFrame:
    """Quality of logged predictions whose true label is known, per model."""
    if hours is not None:
        log = log.where(F.col("ts") >= F.lit(now - timedelta(hours=hours)))
    p, a = F.col("is_malicious"), F.col("actual_label")
    c = log.where(a.isNotNull()).groupBy(*keys).agg(
        count_if(p & a).alias("tp"), count_if(p & ~a).alias("fp"), count_if(~p & a).alias("fn"),
        count_if(p == a).alias("right"), F.avg("confidence_score").alias("avg_confidence"),
        F.avg("response_time_ms").alias("avg_response_time_ms"), F.count("*").alias("sample_count"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return (c.withColumn("accuracy", F.col("right") / F.col("sample_count"))
            .withColumn("precision", precision).withColumn("recall", recall)
            .withColumn("f1_score", ratio(2 * F.col("precision") * F.col("recall"),
                                          F.col("precision") + F.col("recall")))
            .drop("tp", "fp", "fn", "right"))


METRICS = ["accuracy", "precision", "recall", "f1_score", "avg_confidence", "avg_response_time_ms"]


def metric_history(log: DataFrame, unit: str = "hour") -> DataFrame:
    """(model_version, ts, metric_name, metric_value, sample_count): performance per time unit, long form."""
    per = prediction_performance(log.withColumn("slot", F.date_trunc(unit, "ts")), keys=("model_version", "slot"))
    return per.unpivot(["model_version", "slot", "sample_count"], METRICS, "metric_name", "metric_value").select(
        "model_version", F.col("slot").alias("ts"), "metric_name", "metric_value", "sample_count")


def performance_history(metrics: DataFrame, now: datetime, days: float = 30) -> DataFrame:
    return metrics.where(F.col("ts") >= F.lit(now - timedelta(days=days))).orderBy(
        "model_version", "metric_name", "ts")


def normal_cdf_complement(z: Column) -> Column:
    """1 - Phi(z) for z >= 0 by the Abramowitz-Stegun 26.2.17 polynomial (error below 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) * 0.3989422804014327 * poly


def mann_whitney(values: DataFrame, keys: list[str], value: str, side: str) -> DataFrame:
    """Two-sided Mann-Whitney test per key; ``side`` is true for the first sample.

    Works on counts per distinct value: mid-ranks follow from running counts, so
    samples are never collected.
    """
    counted = values.groupBy(*keys, value).agg(count_if(F.col(side)).alias("a"), count_if(~F.col(side)).alias("b"))
    # ranks ascend with the value; ties share the middle rank
    bucket = F.floor(F.col(value) * 64).cast("long")
    ranks = running(counted, keys, [value], bucket, {"upto": ("sum", F.col("a") + F.col("b"))})
    n = F.col("a") + F.col("b")
    mid = F.col("upto") - (n - 1) / 2
    sums = ranks.groupBy(*keys).agg(F.sum(F.col("a") * mid).alias("r1"), F.sum("a").alias("n1"), F.sum("b").alias("n2"),
                                    F.sum((n * n * n - n).cast("double")).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    total = n1 + n2
    sigma = F.sqrt(n1 * n2 / 12 * ((total + 1) - F.coalesce(F.try_divide("ties", total * (total - 1)), F.lit(0.0))))
    z = F.greatest((F.abs(u1 - n1 * n2 / 2) - 0.5) / sigma, F.lit(0.0))
    return sums.withColumn("u", u1).withColumn(
        "p_value", F.when(sigma > 0, F.least(2 * normal_cdf_complement(z), F.lit(1.0))).otherwise(1.0)
    ).select(*keys, "u", "p_value")


def detect_drift(metrics: DataFrame, now: datetime, window_days: float = 7, min_samples: int = 100,
                 threshold: float = 0.1, alpha: float = 0.05) -> DataFrame:
    """Metrics whose recent values moved by more than the threshold and differ significantly."""
    keys = ["model_version", "metric_name"]
    border = F.lit(now - timedelta(days=window_days))
    used = metrics.where((F.col("sample_count") >= min_samples) & (F.col("ts") <= F.lit(now))).withColumn(
        "recent", F.col("ts") >= border)
    means = used.groupBy(*keys).agg(
        F.avg(F.when(F.col("recent"), F.col("metric_value"))).alias("current_value"),
        F.avg(F.when(~F.col("recent"), F.col("metric_value"))).alias("baseline_value"))
    change = F.try_divide(F.abs(F.col("current_value") - F.col("baseline_value")), F.abs("baseline_value"))
    means = means.where((F.col("baseline_value") != 0) & F.col("current_value").isNotNull()).withColumn(
        "drift_score", change)
    tested = means.where(F.col("drift_score") > threshold).join(
        mann_whitney(used, keys, "metric_value", "recent"), keys)
    return drift_severity(tested.where(F.col("p_value") < alpha))


def severity_of_drift() -> Column:
    score = F.col("drift_score")
    return cases([(score > 0.3, "critical"), (score > 0.2, "high"),
                  ((score > 0.1) & (F.col("current_value") < F.col("baseline_value")), "medium")], "low")


def drift_severity(drifts: DataFrame) -> DataFrame:
    """Severity and advice for (current_value, baseline_value, drift_score) rows."""
    shift = F.format_string("%.1f%%", F.col("drift_score") * 100)
    advice = cases([
        (F.col("severity") == "critical",
         F.concat(F.lit("Immediate retraining required. "), "metric_name", F.lit(" moved by "), shift, F.lit("."))),
        (F.col("severity") == "high",
         F.concat(F.lit("Schedule retraining within 24 hours. "), "metric_name", F.lit(" moved by "), shift, F.lit("."))),
        (F.col("severity") == "medium",
         F.concat(F.lit("Plan retraining within 48-72 hours. "), "metric_name", F.lit(" moved by "), shift, F.lit(".")))],
        F.concat(F.lit("Monitor trend. "), "metric_name", F.lit(" moved by "), shift, F.lit(".")))
    return drifts.withColumn("severity", severity_of_drift()).withColumn("recommendation", advice)


def drift_alert_cooldown(drift_alerts: DataFrame, cooldown_seconds: float = 86_400,
                         id_col: str = "alert_id") -> DataFrame:
    """Alerts that are sent: one per (model, metric) and cooldown."""
    return keep_spaced(drift_alerts, ["model_version", "metric_name"], cooldown_seconds, id_col=id_col,
                       bucket_windows=16)


def recent_drift_alerts(drift_alerts: DataFrame, now: datetime, hours: float = 24, model: str | None = None) -> DataFrame:
    out = drift_alerts.where(F.col("ts") > F.lit(now - timedelta(hours=hours)))
    if model is not None:
        out = out.where(F.col("model_version") == model)
    return out.orderBy(F.desc("ts"), "alert_id")


def acknowledge(drift_alerts: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Mark the alerts whose ids are listed."""
    ids = acknowledged.select("alert_id").distinct().withColumn("_ack", F.lit(True))
    return drift_alerts.drop("acknowledged").join(ids, "alert_id", "left").withColumn(
        "acknowledged", F.coalesce("_ack", F.lit(False))).drop("_ack")


def monitoring_summary(metrics: DataFrame, log: DataFrame, drift_alerts: DataFrame, now: datetime) -> DataFrame:
    """(item, n): models, predictions in total and in 24 h, open drift alerts by severity."""
    since = F.lit(now - timedelta(hours=24))
    models = metrics.agg(F.count_distinct("model_version").alias("n")).select(
        F.lit("monitored_models").alias("item"), "n")
    seen = log.agg(F.count("*").alias("total"), count_if(F.col("ts") >= since).alias("recent"))
    seen = seen.select(F.explode(F.array(
        F.struct(F.lit("total_predictions").alias("item"), F.col("total").alias("n")),
        F.struct(F.lit("recent_predictions_24h").alias("item"), F.col("recent").alias("n")))).alias("e")).select("e.*")
    open_ = drift_alerts.where("NOT acknowledged").groupBy(
        F.concat(F.lit("unacknowledged_"), "severity").alias("item")).agg(F.count("*").alias("n"))
    return models.unionByName(seen).unionByName(open_)


def monitoring_recommendations(performance: DataFrame, drift_alerts: DataFrame) -> DataFrame:
    """(model_version, recommendations) from current performance and open critical drifts."""
    critical = drift_alerts.where("severity = 'critical'").groupBy("model_version").agg(F.lit(True).alias("_crit"))
    # fixed values: limits and texts of the recommendations
    return performance.join(critical, "model_version", "left").select("model_version", F.array_compact(F.array(
        F.when(F.col("accuracy") < 0.85, F.lit("Model accuracy is below 85%. Consider retraining.")),
        F.when(F.col("avg_response_time_ms") > 1000, F.lit("Average response time is high. Optimize the model.")),
        F.when(F.col("avg_confidence") < 0.7, F.lit("Average confidence is low. Review training data.")),
        F.when(F.col("sample_count") < 100, F.lit("Low sample count. Collect more data before concluding.")),
        F.when(F.col("_crit"), F.lit("Critical performance drift detected. Immediate action required.")),
    )).alias("recommendations"))


def prediction_stats(predictions: DataFrame, now: datetime | None = None, hours: float | None = None) -> DataFrame:
    """(section, item, value): totals, rate, mean processing time, attack distribution."""
    if hours is not None:
        predictions = predictions.where(F.col("ts") >= F.lit(now - timedelta(hours=hours)))
    types = predictions.groupBy("is_malicious", "attack_type").agg(
        F.count("*").alias("n"), F.sum("processing_time_ms").alias("ms"))
    totals = types.agg(F.sum("n").cast("double").alias("total"),
                       F.coalesce(F.sum(F.when(F.col("is_malicious"), F.col("n"))), F.lit(0)).cast("double").alias("malicious"),
                       F.sum("ms").alias("ms"))
    wide = totals.select("total", "malicious", (F.col("total") - F.col("malicious")).alias("benign"),
                         ratio(F.col("malicious"), F.col("total")).alias("malicious_rate"),
                         ratio(F.col("ms"), F.col("total")).alias("mean_processing_ms"))
    rows = wide.unpivot([], wide.columns, "item", "value").select(F.lit("total").alias("section"), "item", "value")
    attacks = types.where("is_malicious").select(F.lit("attack").alias("section"), F.col("attack_type").alias("item"),
                                                 F.col("n").cast("double").alias("value"))
    return rows.unionByName(attacks)


def threat_counters(predictions: DataFrame) -> DataFrame:
    """(metric, label, n): predictions by version and outcome, threats by type and severity, confidence buckets.

    Buckets are cumulative: a row counts in every bucket whose upper bound it does not exceed.
    """
    severity = F.when(F.col("confidence_score") > 0.9, "HIGH").otherwise("MEDIUM")
    # scores are rounded up to tenths first, so the cube of counts stays tiny
    tenth = F.ceil(F.round(F.col("confidence_score") * 10, 9)).cast("int")
    cells = predictions.groupBy("model_version", "is_malicious", "attack_type", severity.alias("severity"),
                                tenth.alias("tenth")).agg(F.count("*").alias("c"))
    outcome = F.when(F.col("is_malicious"), F.coalesce("attack_type", F.lit("unknown"))).otherwise("benign")
    entries = F.array_compact(F.array(
        F.struct(F.lit("predictions").alias("metric"), F.concat_ws(":", "model_version", outcome).alias("label"), "c"),
        F.when(F.col("is_malicious"), F.struct(
            F.lit("threats").alias("metric"),
            F.concat_ws(":", F.coalesce("attack_type", F.lit("unknown")), "severity").alias("label"), "c"))))
    buckets = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda b: F.when(F.col("tenth") <= b, F.struct(
        F.lit("confidence_le").alias("metric"), F.format_string("%.1f", b / F.lit(10.0)).alias("label"), "c")))
    return cells.select(F.explode(F.concat(entries, F.array_compact(buckets))).alias("e")).groupBy(
        "e.metric", "e.label").agg(F.sum("e.c").alias("n"))


def minute_counts(df: DataFrame, keys: list[str] = []) -> DataFrame:
    """Per-minute pre-aggregates the rate windows are built from."""
    return df.groupBy(*keys, F.date_trunc("minute", "ts").alias("minute")).agg(
        F.count("*").alias("requests"), count_if(F.col("is_malicious")).alias("threats"))


def metric_rates(df: DataFrame, window_minutes: int = 5) -> DataFrame:
    """Per sliding window (step one minute): requests/s, threats/s, threat share and p95 processing time.

    Raw rows are first counted per (minute, value); every window then combines
    the few minutes it covers instead of copying raw rows.
    """
    cells = df.groupBy(F.date_trunc("minute", "ts").alias("minute"), "processing_time_ms").agg(
        F.count("*").alias("c"), count_if(F.col("is_malicious")).alias("bad"))
    spread = cells.withColumn("end", F.explode(F.transform(
        F.sequence(F.lit(1), F.lit(window_minutes)),
        lambda i: F.timestamp_seconds(F.unix_seconds("minute") + i * 60))))
    per_value = spread.groupBy("end", "processing_time_ms").agg(F.sum("c").alias("c"), F.sum("bad").alias("bad"))
    width = F.lit(window_minutes * 60.0)
    return per_value.groupBy("end").agg(
        (F.sum("c") / width).alias("request_rate"), (F.sum("bad") / width).alias("threat_rate"),
        F.sum("bad").alias("threat_increase"), ratio(F.sum("bad"), F.sum("c")).alias("threat_ratio"),
        F.percentile(F.col("processing_time_ms").cast("double"), F.lit(0.95), F.col("c")).alias("p95_ms"))


def firing_alerts(rates: DataFrame, column: str, threshold: float, for_minutes: int) -> DataFrame:
    """Spells of consecutive minutes beyond the threshold that lasted at least ``for`` minutes."""
    over = rates.where(F.col(column) > threshold).select("end", F.col(column).alias("value"))
    minute = (F.unix_seconds("end") / 60).cast("long")
    # gaps and islands on at most one row per minute
    spell = minute - F.row_number().over(Window.orderBy("end"))
    return (over.withColumn("_s", spell).groupBy("_s").agg(
        F.min("end").alias("since"), F.max("end").alias("until"), F.max("value").alias("peak"),
        F.count("*").alias("minutes")).where(F.col("minutes") > for_minutes).drop("_s"))


def request_quota(log: DataFrame, limit: int, key: str = "user_id", endpoint: str = "event_type",
                  id_col: str = "event_id") -> DataFrame:
    """Number every request inside (key, endpoint, clock hour) and flag those beyond the limit."""
    keyed = log.withColumn("hour", F.date_trunc("hour", "ts"))
    counted = running(keyed, [key, endpoint, "hour"], ["ts", id_col], F.floor(F.unix_seconds("ts") / 60).cast("long"),
                      {"request_no": ("count", F.lit(1))})
    return counted.withColumn("over_limit", F.col("request_no") > limit)
