"""Flow sessions and the flow-based, statistical and global features of packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions import net
from tarnwatch.functions.columns import seconds
from tarnwatch.operators import features
from tarnwatch.operators.scan import BUCKET, running, time_bucket

FLOW_TIMEOUT = 300
ORDER = ["ts", "record_id"]
BLOCK_ROWS = 50_000


def with_flow_key(df: DataFrame, flow_cols=None) -> DataFrame:
    """Flow key over all five fields, or over the given columns only."""
    key = net.flow_key() if flow_cols is None else F.concat_ws("|", *flow_cols)
    return df.withColumn("flow_key", key)


def flows(df: DataFrame, timeout: int = FLOW_TIMEOUT, flow_cols=None) -> DataFrame:
    """One row per flow session; a gap longer than the timeout ends a session.

    Sessions are first folded per (flow, time slice) where slices are split at
    gaps too, so the shuffle and the final merge see one row per slice.
    """
    return sessions(with_flow_key(df, flow_cols), timeout)


def sessions(df: DataFrame, timeout: int) -> DataFrame:
    """Merge packets to partial sessions inside a slice, then partial sessions across slices."""
    width = timeout * 12
    base = df.withColumn(BUCKET, time_bucket("ts", width)).select(
        "flow_key", BUCKET, "ts", "packet_size", "flags")
    local = Window.partitionBy("flow_key", BUCKET).orderBy("ts")
    step = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(local)
    part = base.withColumn("_new", F.when(step > timeout * 1_000_000, 1).otherwise(0)).withColumn(
        "_part", F.sum("_new").over(local))
    partial = part.groupBy("flow_key", BUCKET, "_part").agg(
        F.count("*").alias("c"), F.sum("packet_size").alias("b"), F.min("ts").alias("s"),
        F.max("ts").alias("e"), F.collect_set("flags").alias("f"))
    partial = partial.withColumn("f", F.array_distinct(F.flatten("f")))
    across = Window.partitionBy("flow_key").orderBy("s")
    gap = F.unix_micros("s") - F.lag(F.unix_micros("e")).over(across)
    merged = partial.withColumn(
        "_session", F.sum(F.when(gap > timeout * 1_000_000, 1).otherwise(0)).over(across))
    return (merged.groupBy("flow_key", "_session")
            .agg(F.sum("c").alias("packet_count"), F.sum("b").alias("total_bytes"),
                 F.min("s").alias("start_time"), F.max("e").alias("last_time"),
                 F.array_sort(F.array_distinct(F.flatten(F.collect_set("f")))).alias("flags"))
            .withColumn("duration", seconds("last_time") - seconds("start_time"))
            .drop("_session"))


def sessionize(df: DataFrame, timeout: int = FLOW_TIMEOUT) -> DataFrame:
    """Add per packet: session start, packets and bytes so far, and the inter-arrival time.

    Cumulative values come from two-level running sums over the flow; the base of
    a session is the running maximum of the values at session starts, which is
    valid because time, count and bytes never decrease along a flow.
    """
    width = timeout * 12
    base = df.withColumn(BUCKET, time_bucket("ts", width))
    w = Window.partitionBy("flow_key", BUCKET).orderBy(*ORDER)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    micros = F.unix_micros("ts")
    local = (base.withColumn("_prev", F.lag(micros).over(w))
             .withColumn("_n", F.row_number().over(w))
             .withColumn("_sum", F.sum("packet_size").over(upto))
             .withColumn("_break", F.when(micros - F.col("_prev") > timeout * 1_000_000, F.struct(
                 micros.alias("start"), (F.col("_n") - 1).cast("long").alias("n"),
                 (F.col("_sum") - F.col("packet_size")).cast("long").alias("b"))))
             .withColumn("_base", F.max("_break").over(upto)))

    # one summary row per (flow, slice), carried forward along the flow
    summary = (local.groupBy("flow_key", BUCKET)
               .agg(F.min(micros).alias("first"), F.max(micros).alias("last"),
                    F.count("*").alias("n"), F.sum("packet_size").alias("b"),
                    F.max("_base").alias("inner")))
    along = Window.partitionBy("flow_key").orderBy(BUCKET)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    summary = (summary.withColumn("prev_last", F.lag("last").over(along))
               .withColumn("cum_n", F.coalesce(F.sum("n").over(before), F.lit(0)))
               .withColumn("cum_b", F.coalesce(F.sum("b").over(before), F.lit(0)))
               .withColumn("opens", F.when(
                   F.col("prev_last").isNull()
                   | (F.col("first") - F.col("prev_last") > timeout * 1_000_000),
                   F.struct(F.col("first").alias("start"), F.col("cum_n").alias("n"),
                            F.col("cum_b").alias("b"))))
               .withColumn("latest", F.coalesce(F.when(F.col("inner").isNotNull(), F.struct(
                   F.col("inner.start").alias("start"), (F.col("inner.n") + F.col("cum_n")).alias("n"),
                   (F.col("inner.b") + F.col("cum_b")).alias("b"))), F.col("opens")))
               .withColumn("carry", F.coalesce("opens", F.max("latest").over(before)))
               .select(F.col("flow_key").alias("_fk"), F.col(BUCKET).alias("_fb"), "prev_last",
                       F.col("opens").isNotNull().alias("fresh"), "cum_n", "cum_b", "carry"))

    joined = local.join(summary, (F.col("flow_key") == F.col("_fk")) & (F.col(BUCKET) == F.col("_fb")))
    own = F.col("_base").isNotNull()
    start = F.when(own, F.col("_base.start")).otherwise(F.col("carry.start"))
    n0 = F.when(own, F.col("_base.n") + F.col("cum_n")).otherwise(F.col("carry.n"))
    b0 = F.when(own, F.col("_base.b") + F.col("cum_b")).otherwise(F.col("carry.b"))
    previous = F.coalesce("_prev", F.when(~F.col("fresh"), F.col("prev_last")))
    arrival = F.when(F.col("_break").isNull(), (micros - previous) / 1e6)
    return joined.select(
        *[F.col(c) for c in df.columns],
        F.timestamp_micros(start).alias("session_start"),
        (F.col("_n") + F.col("cum_n") - n0).alias("session_packets"),
        (F.col("_sum") + F.col("cum_b") - b0).alias("session_bytes"),
        arrival.alias("inter_arrival"))


def _flow_columns() -> dict:
    duration = seconds("ts") - seconds("session_start")
    floor = F.greatest(duration, F.lit(0.001))
    return {
        "flow_duration": duration,
        "flow_packet_count": F.col("session_packets").cast("double"),
        "flow_bytes_total": F.col("session_bytes").cast("double"),
        "flow_bytes_per_second": F.col("session_bytes") / floor,
        "flow_packets_per_second": F.col("session_packets") / floor,
    }


def running_flow_features(df: DataFrame, timeout: int = FLOW_TIMEOUT, flow_cols=None) -> DataFrame:
    """Cumulative flow features of every packet since its flow session began."""
    return sessionize(with_flow_key(df, flow_cols), timeout).withColumns(_flow_columns())


def _recent_stats(sessionized: DataFrame, n: int) -> DataFrame:
    """Statistics over the last ``n`` packets of the session.

    The position inside the session cuts long sessions into blocks of fixed size;
    the last rows of a block are copied into the next one as context.
    """
    position = F.col("session_packets") - 1
    block = F.floor(position / BLOCK_ROWS).cast("long")
    near_end = (position % BLOCK_ROWS) >= BLOCK_ROWS - n
    spread = (sessionized
              .withColumn("_copy", F.explode(F.when(near_end, F.array(F.lit(0), F.lit(1)))
                                             .otherwise(F.array(F.lit(0)))))
              .withColumn("_block", block + F.col("_copy")))
    w = (Window.partitionBy("flow_key", "session_start", "_block").orderBy("session_packets")
         .rowsBetween(-(n - 1), 0))
    stats = {}
    for name, source in (("packet_size", "packet_size"), ("inter_arrival", "inter_arrival")):
        for label, fn in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max)):
            stats[f"{name}_{label}"] = F.coalesce(fn(source).over(w).cast("double"), F.lit(0.0))
    return spread.withColumns(stats).where("_copy = 0").drop("_copy", "_block")


def recent_flow_stats(df: DataFrame, n: int = 100, timeout: int = FLOW_TIMEOUT, flow_cols=None) -> DataFrame:
    return _recent_stats(sessionize(with_flow_key(df, flow_cols), timeout), n)


def global_frequency_features(df: DataFrame, n: int = 100, bucket_seconds: int = 10) -> DataFrame:
    """``record_id`` with protocol and port frequencies against all earlier packets.

    Counts are carried over seconds, then over hours of an item, so the packets of one
    protocol meet by ``bucket_seconds`` only, and its summaries by hour.

    Source and destination ports share one counter, the current packet included.
    The denominator only depends on the position for the first ``n`` packets.
    """
    slots = F.array(
        F.struct(F.lit("proto").alias("slot"), F.concat(F.lit("p:"), "protocol").alias("item")),
        F.struct(F.lit("src").alias("slot"), F.col("source_port").cast("string").alias("item")),
        F.struct(F.lit("dst").alias("slot"), F.col("destination_port").cast("string").alias("item")))
    long = df.select("record_id", "ts", F.explode(slots).alias("s")).select(
        "record_id", "ts", "s.slot", "s.item")
    counted = running(long, ["item"], ORDER, time_bucket("ts", bucket_seconds),
                      {"seen": ("count", F.lit(1))}, peers=True, group=max(3600 // bucket_seconds, 2))
    first = (df.select("record_id", "ts").orderBy(*ORDER).limit(n)
             .select("record_id", F.row_number().over(Window.orderBy(*ORDER)).alias("rn")))
    pick = lambda slot: F.max(F.when(F.col("slot") == slot, F.col("seen")))
    per_record = counted.groupBy("record_id").agg(
        pick("proto").alias("c_proto"), pick("src").alias("c_src"), pick("dst").alias("c_dst"))
    position = F.coalesce(F.col("rn"), F.lit(n)).cast("double")
    return per_record.join(F.broadcast(first), "record_id", "left").select(
        "record_id", (F.col("c_proto") / position).alias("protocol_frequency"),
        (F.col("c_src") / position).alias("port_frequency_src"),
        (F.col("c_dst") / position).alias("port_frequency_dst"))


def traffic_features(df: DataFrame, n: int = 100, timeout: int = FLOW_TIMEOUT, flow_cols=None) -> DataFrame:
    """All 29 features per packet, in training order, keyed by ``record_id``."""
    flow = _recent_stats(sessionize(with_flow_key(df, flow_cols), timeout), n).withColumns(_flow_columns())
    flow = features.time_features(features.port_features(features.flag_features(features.basic_features(flow))))
    ready = flow.select("record_id", *K.FEATURE_NAMES[:-3])
    return ready.join(global_frequency_features(df, n), "record_id").select("record_id", *K.FEATURE_NAMES)


def flow_summary(df: DataFrame, timeout: int = FLOW_TIMEOUT, flow_cols=None, top: int = 10) -> DataFrame:
    """(section, item, n): flows still active at the end, protocol counts, top ports."""
    end = df.agg(F.max("ts")).first()[0]
    keyed = with_flow_key(df, flow_cols)
    latest = keyed.groupBy("flow_key").agg(F.max("ts").alias("last"))
    active = latest.where(F.unix_micros(F.lit(end)) - F.unix_micros("last") <= timeout * 1_000_000).agg(
        F.lit("flows").alias("section"), F.lit("active").alias("item"), F.count("*").alias("n"))
    protocols = df.groupBy(F.lit("protocol").alias("section"), F.col("protocol").alias("item")).agg(
        F.count("*").alias("n"))
    ports = (df.select(F.explode(F.array("source_port", "destination_port")).alias("port"))
             .groupBy("port").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "port").limit(top)
             .select(F.lit("port").alias("section"), F.col("port").cast("string").alias("item"), "n"))
    return active.unionByName(protocols).unionByName(ports)


def align_features(df: DataFrame, names=None, scaling: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Columns a model was trained on: missing ones become 0.0, then fitted scaling applies."""
    names = list(names or K.FEATURE_NAMES)
    out = []
    for name in names:
        value = F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)
        if scaling and name in scaling:
            center, scale = scaling[name]
            value = (value - F.lit(float(center))) / F.lit(float(scale) or 1.0)
        out.append(value.alias(name))
    keep = [c for c in ("record_id",) if c in df.columns]
    return df.select(*keep, *out)
