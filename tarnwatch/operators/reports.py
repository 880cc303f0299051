"""Report and dashboard queries over alerts, predictions and traffic."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.columns import count_if, ratio, seconds
from tarnwatch.operators.features import confidence_bin
from tarnwatch.operators.intel import geolocate


def in_period(df: DataFrame, start: datetime | None, end: datetime | None, ts: str = "ts") -> DataFrame:
    """Closed time range on the raw column, so the filter reaches the scan."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end))
    return df


def counts_by(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    return in_period(df, start, end).groupBy(column).agg(F.count("*").alias("n"))


def threats_by_type(alerts: DataFrame, start=None, end=None) -> DataFrame:
    return counts_by(alerts, "attack_type", start, end)


def threats_by_severity(alerts: DataFrame, start=None, end=None) -> DataFrame:
    return counts_by(alerts, "severity", start, end)


def top_addresses(alerts: DataFrame, column: str, limit: int = 10, start=None, end=None) -> DataFrame:
    return counts_by(alerts, column, start, end).orderBy(F.desc("n"), column).limit(limit)


def hours_between(spark, start: datetime, end: datetime) -> DataFrame:
    first = F.date_trunc("hour", F.lit(start))
    return spark.range(1).select(F.explode(F.sequence(
        first, F.lit(end).cast("timestamp"), F.expr("INTERVAL 1 HOUR"))).alias("hour"))


def threat_timeline(alerts: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Every hour of the period with its alerts in total, by type and by severity (as maps)."""
    first = F.date_trunc("hour", F.lit(start))
    last = F.date_trunc("hour", F.lit(end)) + F.expr("INTERVAL 1 HOUR")
    cells = (alerts.where((F.col("ts") >= first) & (F.col("ts") < last))
             .groupBy(F.date_trunc("hour", "ts").alias("hour"), "attack_type", "severity")
             .agg(F.count("*").alias("c")))

    def as_map(column):
        per = cells.groupBy("hour", column).agg(F.sum("c").alias("c"))
        return per.groupBy("hour").agg(F.map_from_entries(F.array_sort(
            F.collect_list(F.struct(column, "c")))).alias(f"by_{column}"), F.sum("c").alias(f"n_{column}"))

    out = hours_between(alerts.sparkSession, start, end)
    out = out.join(as_map("attack_type"), "hour", "left").join(as_map("severity"), "hour", "left")
    empty = F.expr("CAST(map() AS map<string,bigint>)")
    return out.select("hour", F.coalesce("n_attack_type", F.lit(0)).alias("total_threats"),
                      F.coalesce("by_attack_type", empty).alias("threats_by_type"),
                      F.coalesce("by_severity", empty).alias("threats_by_severity"))


def threat_report(alerts: DataFrame, start: datetime, end: datetime, limit: int = 10) -> DataFrame:
    """(section, item, n) rows of all threat sections.

    Types, severities, confidence bins, hours and the total come from one aggregate over grouping sets; only the two
    address sections, which hold many values, are aggregates of their own. Counts are combined before they are
    shuffled. Hours and bins without alerts are present with 0.
    """
    period = in_period(alerts, start, end)
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH")
    rows = period.select(F.col("attack_type").cast("string").alias("type"), F.col("severity").cast("string").alias("severity"),
                         confidence_bin("confidence_score").alias("confidence"), hour.alias("hour"))
    names = rows.columns
    sets = rows.groupingSets([[F.col(c)] for c in names] + [[]], *[F.col(c) for c in names])
    counted = sets.agg(*[(F.grouping(c) == 0).alias(f"_{c}") for c in names], F.count("*").alias("n"))
    section, item = F.lit("total"), F.lit("threats")
    for c in names:
        section, item = F.when(F.col(f"_{c}"), F.lit(c)).otherwise(section), F.when(F.col(f"_{c}"), F.col(c)).otherwise(item)
    counted = counted.select(section.alias("section"), item.alias("item"), "n")

    zero = F.lit(0).cast("long").alias("n")
    fixed = [("total", "threats"), *[("confidence", name) for _, name in K.CONFIDENCE_BINS], ("confidence", K.LOWEST_CONFIDENCE_BIN)]
    empty = alerts.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("section"), F.lit(b).alias("item")) for a, b in fixed])).alias("f"))
    hours = hours_between(alerts.sparkSession, start, end).select(F.lit("hour").alias("section"), F.date_format("hour", "yyyy-MM-dd HH").alias("item"), zero)
    out = counted.unionByName(empty.select("f.*", zero)).unionByName(hours).groupBy("section", "item").agg(F.sum("n").alias("n"))
    for name, column in (("source", "source_ip"), ("target", "destination_ip")):
        top = top_addresses(period, column, limit)
        out = out.unionByName(top.select(F.lit(name).alias("section"), F.col(column).cast("string").alias("item"), "n"))
    return out


def summary_report(threats: DataFrame, models: DataFrame, top: int = 5) -> DataFrame:
    """(section, item, value) over report rows ``(report_id, section, item, n)`` and model rows.

    ``models`` has model_name, accuracy, f1_macro and inference_time.
    """
    counts = threats.groupBy("section", "item").agg(F.sum("n").alias("n"))
    total = counts.where("section = 'total'").agg(
        F.lit("threats").alias("section"), F.lit("total").alias("item"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("value"))
    reports = threats.agg(F.lit("threats").alias("section"), F.lit("reports").alias("item"),
                          F.count_distinct("report_id").cast("double").alias("value"))
    types = (counts.where("section = 'type'").orderBy(F.desc("n"), "item").limit(top)
             .select(F.lit("top_type").alias("section"), "item", F.col("n").cast("double").alias("value")))
    severities = counts.where("section = 'severity'").select(
        F.lit("severity").alias("section"), "item", F.col("n").cast("double").alias("value"))
    stats = models.agg(F.count("*").cast("double").alias("model_count"), F.avg("accuracy").alias("average_accuracy"),
                       F.avg("f1_macro").alias("average_f1_score"),
                       F.avg("inference_time").alias("average_inference_time"))
    model_rows = stats.unpivot([], stats.columns, "item", "value").select(
        F.lit("models").alias("section"), "item", "value")
    # fixed values: limits and texts of the recommendations
    advice_models = stats.select(F.explode(F.array_compact(F.array(
        F.when(F.col("average_accuracy") < 0.9,
               F.lit("Model accuracy below 90%. Consider retraining with additional data.")),
        F.when(F.col("average_inference_time") > 0.1,
               F.lit("Model inference time above 100ms. Consider optimization for real-time detection."))))).alias("item"))
    critical = severities.where("item = 'CRITICAL' AND value > 0").select(F.format_string(
        "High priority: %d critical threats detected. Immediate investigation required.",
        F.col("value").cast("long")).alias("item"))
    common = types.orderBy(F.desc("value"), "item").limit(1).select(F.format_string(
        "Most common attack type: %s (%d incidents). Consider targeted defenses.",
        "item", F.col("value").cast("long")).alias("item"))
    advice = critical.unionByName(common).unionByName(advice_models).select(
        F.lit("recommendation").alias("section"), "item", F.lit(1.0).alias("value"))
    return (total.unionByName(reports).unionByName(types).unionByName(severities)
            .unionByName(model_rows).unionByName(advice))


def key_metrics(alerts: DataFrame, start: datetime, end: datetime, status: Column | None = None) -> DataFrame:
    """Totals of a period and of the equally long period before it, in one pass, with the change.

    Distinct sources are counted from a per-source pre-aggregation.
    """
    length = end - start
    scope = in_period(alerts, start - length, end).withColumn(
        "now", F.when(F.col("ts") >= F.lit(start), 1).otherwise(0))
    open_ = F.lit(True) if status is None else status
    per_source = scope.groupBy("now", "source_ip").agg(
        F.count("*").alias("total"), count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.sum("confidence_score").alias("conf"), count_if(open_).alias("open"))
    periods = per_source.groupBy("now").agg(
        F.sum("total").alias("total"), F.sum("critical").alias("critical"), F.sum("conf").alias("conf"),
        F.count("source_ip").alias("sources"), F.sum("open").alias("open"))

    def pick(name, flag):
        return F.coalesce(F.max(F.when(F.col("now") == flag, F.col(name))), F.lit(0))

    names = ["total", "critical", "sources", "open"]
    wide = periods.agg(*[pick(n, 1).alias(n) for n in names], *[pick(n, 0).alias(f"{n}_before") for n in names],
                       pick("conf", 1).alias("conf"))
    return wide.select("total", "critical", ratio(F.col("conf"), F.col("total")).alias("mean_confidence"),
                       F.col("sources").alias("unique_sources"), F.col("open").alias("open_incidents"),
                       *[(F.col(n) - F.col(f"{n}_before")).alias(f"{n}_delta") for n in names])


def timeline_by_severity(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.date_trunc("hour", "ts").alias("hour"), "severity").agg(F.count("*").alias("n"))


def timeline_pivot(alerts: DataFrame) -> DataFrame:
    """Hour rows with one column per severity."""
    return (alerts.groupBy(F.date_trunc("hour", "ts").alias("hour"))
            .agg(*[count_if(F.col("severity") == s).alias(s.lower()) for s in ("LOW", "MEDIUM", "HIGH", "CRITICAL")]))


def source_ip_analysis(alerts: DataFrame) -> DataFrame:
    """Threats, mean confidence and attack types per source, busiest first."""
    return (alerts.groupBy("source_ip").agg(
        F.count("*").alias("threats"), F.avg("confidence_score").alias("mean_confidence"),
        F.array_join(F.array_sort(F.collect_set("attack_type")), ", ").alias("attack_types"))
        .orderBy(F.desc("threats"), "source_ip"))


def recent_predictions(predictions: DataFrame, now: datetime, hours: float = 24, limit: int = 1000) -> DataFrame:
    since = F.lit(now) - F.make_dt_interval(hours=F.lit(int(hours)))
    return predictions.where(F.col("ts") >= since).orderBy(F.desc("ts"), "record_id").limit(limit)


def model_performance(metrics: DataFrame, now: datetime, hours: float = 24) -> DataFrame:
    since = F.lit(now) - F.make_dt_interval(hours=F.lit(int(hours)))
    return metrics.where(F.col("ts") >= since).orderBy(F.desc("ts"))


def topology_edges(traffic: DataFrame) -> DataFrame:
    """Undirected address pairs with volume, protocols and last contact."""
    return traffic.groupBy(F.least("source_ip", "destination_ip").alias("a"),
                           F.greatest("source_ip", "destination_ip").alias("b")).agg(
        F.count("*").alias("connections"), F.sum("packet_size").alias("bytes"),
        F.array_join(F.array_sort(F.collect_set("protocol")), ",").alias("protocols"),
        F.max("ts").alias("last_seen"))


def topology_metrics(edges: DataFrame) -> DataFrame:
    """nodes, edges, density and mean degree of the address graph (self loops count twice in degree)."""
    degree = (edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d")))
    stats = degree.agg(F.count("*").alias("nodes"), F.sum("d").alias("ends"))
    return stats.select("nodes", (F.col("ends") / 2).cast("long").alias("edges"),
                        F.when(F.col("nodes") > 1, F.col("ends") / (F.col("nodes") * (F.col("nodes") - 1)))
                        .otherwise(0.0).alias("density"), ratio(F.col("ends"), F.col("nodes")).alias("mean_degree"))


def country_stats(alerts: DataFrame, geo: DataFrame, limit: int = 10) -> DataFrame:
    """Threats and distinct addresses per country: counted per address first, then located."""
    per_ip = alerts.groupBy("source_ip").agg(F.count("*").alias("c"))
    return (geolocate(per_ip, geo, "source_ip").where("country IS NOT NULL").groupBy("country")
            .agg(F.sum("c").alias("threats"), F.count("*").alias("unique_ips"))
            .orderBy(F.desc("threats"), "country").limit(limit))


def incident_stats(history: DataFrame, now: datetime) -> DataFrame:
    """Open, investigating, resolved today and mean hours to resolution from status changes."""
    latest = history.groupBy("alert_id").agg(
        F.max_by("status", F.struct("ts", "status")).alias("status"), F.min("ts").alias("opened"),
        F.max(F.when(F.col("status") == "resolved", F.col("ts"))).alias("resolved_at"))
    resolved = F.col("status") == "resolved"
    today = F.to_date("resolved_at") == F.to_date(F.lit(now))
    hours = (seconds("resolved_at") - seconds("opened")) / 3600
    return latest.agg(count_if(F.col("status") == "open").alias("open"),
                      count_if(F.col("status") == "investigating").alias("investigating"),
                      count_if(resolved & today).alias("resolved_today"),
                      F.avg(F.when(resolved, hours)).alias("mean_resolution_hours"))


def confidence_histogram(predictions: DataFrame, bins: int = 20) -> DataFrame:
    """Rows per class and confidence bin; the top edge belongs to the last bin."""
    bin_ = F.least(F.width_bucket("confidence_score", F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins))
    return predictions.groupBy("is_malicious", (bin_ - 1).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def filter_options(alerts: DataFrame, start=None, end=None) -> DataFrame:
    """Values a dashboard offers for filtering: severities, types, number of sources."""
    per_source = in_period(alerts, start, end).groupBy("source_ip").agg(
        F.collect_set("severity").alias("s"), F.collect_set("attack_type").alias("t"))
    return per_source.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("s")))).alias("severities"),
                          F.array_sort(F.array_distinct(F.flatten(F.collect_set("t")))).alias("attack_types"),
                          F.count("source_ip").alias("sources"))


def ranked(df: DataFrame, partition: list[str], order, n: int) -> DataFrame:
    """Top ``n`` rows per small group."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
