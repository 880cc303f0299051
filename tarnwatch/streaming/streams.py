"""Structured Streaming twins of the batch operators, in event time."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnwatch.functions.columns import count_if, seconds
from tarnwatch.operators import behavior as B
from tarnwatch.operators import correlate as C
from tarnwatch.operators.alerts import DEDUP_KEY
from tarnwatch.operators.flows import FLOW_TIMEOUT, with_flow_key
from tarnwatch.operators.scan import BUCKET, with_lookback
from tarnwatch.session import ensure_checkpoint_dir

TRAFFIC_SCHEMA = """record_id long, ts timestamp, source_ip string, destination_ip string, source_port int,
  destination_port int, protocol string, packet_size long, duration double, flags array<string>,
  features map<string,double>, label string"""


# --- sources and running -----------------------------------------------------------------

def stream_traffic(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Traffic records from a folder of JSON-lines files."""
    reader = spark.readStream.schema(TRAFFIC_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def stream_traffic_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Traffic records from a Kafka topic (needs the Kafka connector on the classpath)."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic).load())
    return parse_messages(raw.select(F.col("value").cast("string").alias("value")))


def parse_messages(messages: DataFrame, schema: str = TRAFFIC_SCHEMA) -> DataFrame:
    """JSON message texts to traffic columns; messages that do not parse are dropped."""
    parsed = messages.select(F.from_json("value", schema).alias("r"))
    return parsed.where("r IS NOT NULL AND r.ts IS NOT NULL").select("r.*")


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, which all executors can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, name: str = "stream") -> DataFrame:
    """Process everything available in append mode and return the written table."""
    spark, folder = stream.sparkSession, work_folder(stream.sparkSession, name)
    query = (stream.writeStream.format("parquet").option("path", f"{folder}/out")
             .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def alert_actions(stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str,
                  interval: str | None = None):
    """Start a query that hands every micro-batch to ``action(batch, batch_id)``."""
    writer = stream.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


# --- stateless ------------------------------------------------------------------------------

def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Classify records as they arrive; batch size is the source's ``maxFilesPerTrigger``."""
    return score(stream)


def drop_aged(stream: DataFrame, max_age_seconds: float = 5, ingest: str = "ingest_ts") -> DataFrame:
    """Discard records that were already older than the allowed age when they arrived."""
    return stream.where(seconds(ingest) - seconds("ts") <= max_age_seconds)


# --- windows --------------------------------------------------------------------------------

def flow_stream(stream: DataFrame, timeout: int = FLOW_TIMEOUT, delay: str = "0 seconds", flow_cols=None) -> DataFrame:
    """Flow sessions, emitted once the watermark has passed their timeout."""
    # session windows end one timeout after the last packet; a gap of exactly the timeout still belongs
    return (with_flow_key(stream, flow_cols).withWatermark("ts", delay)
            .groupBy("flow_key", F.session_window("ts", f"{timeout * 1_000_000 + 1} microseconds"))
            .agg(F.count("*").alias("packet_count"), F.sum("packet_size").alias("total_bytes"),
                 F.min("ts").alias("start_time"), F.max("ts").alias("last_time"),
                 F.array_sort(F.array_distinct(F.flatten(F.collect_set("flags")))).alias("flags"))
            .withColumn("duration", seconds("last_time") - seconds("start_time"))
            .drop("session_window"))


def coordinated_stream(stream: DataFrame, sources: int = 5, volume: int = 20, delay: str = "10 minutes") -> DataFrame:
    """Hours with many sources and many events, exact: by (hour, source) first, then by hour."""
    per_source = (stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "source_ip").agg(F.count("*").alias("n")))
    return (per_source.groupBy(F.window(F.window_time("window"), "1 hour"))
            .agg(F.count("*").alias("sources"), F.sum("n").alias("events"))
            .where((F.col("sources") > sources) & (F.col("events") > volume))
            .select(F.col("window.start").alias("hour"), "sources", "events"))


def rates_stream(stream: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Events and threats per second over five minutes, every minute."""
    return (stream.withWatermark("ts", delay).groupBy(F.window("ts", "5 minutes", "1 minute"))
            .agg((F.count("*") / 300.0).alias("request_rate"),
                 (count_if(F.col("is_malicious")) / 300.0).alias("threat_rate"))
            .select(F.col("window.end").alias("end"), "request_rate", "threat_rate"))


# --- stateful ---------------------------------------------------------------------------------

def dedup_alert_stream(stream: DataFrame, window_seconds: float = 300, delay: str = "1 minute",
                       id_col: str = "record_id") -> DataFrame:
    """Exact greedy suppression: the state of a key is the time of its last kept alert.

    State expires one window after that time, when no later alert can be suppressed.
    """
    window = int(window_seconds * 1_000_000)

    def keep(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["_t", id_col])
        times, mask, at = rows["_t"].to_numpy(), np.zeros(len(rows), dtype=bool), 0
        if last is not None:
            at = int(np.searchsorted(times, last + window))
        while at < len(times):
            mask[at] = True
            last = int(times[at])
            at = int(np.searchsorted(times, last + window))
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(last // 1000 + window // 1000, state.getCurrentWatermarkMs() + 1))
        if mask.any():
            yield rows.loc[mask, [id_col, "ts", *DEDUP_KEY]]

    id_type = stream.schema[id_col].dataType.simpleString()
    fields = ", ".join(f"{c} string" for c in DEDUP_KEY)
    return (stream.select(id_col, "ts", *DEDUP_KEY, F.unix_micros("ts").alias("_t")).withWatermark("ts", delay)
            .groupBy(*DEDUP_KEY).applyInPandasWithState(
        keep, f"{id_col} {id_type}, ts timestamp, {fields}", "last long", "append", GroupStateTimeout.EventTimeTimeout))


def dedup_alert_stream_approximate(stream: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Cheaper variant: first alert per key within the watermark delay."""
    return stream.withWatermark("ts", window).dropDuplicatesWithinWatermark(DEDUP_KEY)


#: Rule slices (as the batch operator cuts a key's time line) that share one state of a correlation stream.
STATE_SLICES = 8


def correlate_stream(stream: DataFrame, rule: C.CorrelationRule, delay: str = "1 minute") -> DataFrame:
    """Matches of one correlation rule for every new event.

    A state belongs to a rule key and a slice of time, with the rule window before the slice copied into it, so
    neither a batch nor a state of a key grows with the time that the input spans. It holds the events of one rule
    window before the watermark and later ones; the whole state goes once the watermark has passed it. An event
    that is late, but not later than ``delay``, is matched with its partners; events
    after it that were matched before are not matched anew.
    """
    columns = ["event_id", "_t", "attack_type", "source_ip", "stage_idx", "sev_idx"]
    window = rule.window_seconds * 1_000_000
    matcher = C.rule_matcher(rule)

    def correlate(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        fresh = pd.concat(list(batches))[[*columns, "_own"]]
        if state.exists:
            kept = pd.DataFrame(dict(zip(columns, state.get))).assign(_own=False)
            fresh = pd.concat([kept, fresh])
        rows = fresh.sort_values(["_t", "event_id"]).reset_index(drop=True)
        newest = int(rows["_t"].iloc[-1])
        # the rows of a state form one group
        out = matcher(rows.assign(_bucket=1), np.zeros(len(rows), dtype=np.int64), span=2 * newest + window)
        # an event as late as the watermark allows still needs its partners of one window before it
        late = min(newest, state.getCurrentWatermarkMs() * 1000)
        tail = rows[rows["_t"] >= late - window]
        state.update(tuple(tail[c].tolist() for c in columns))
        state.setTimeoutTimestamp(max(newest // 1000 + window // 1000, state.getCurrentWatermarkMs() + 1))
        if len(out):
            yield out

    keys = ([F.col("source_ip").alias("_key_source")] if rule.same_source else []) + (
        [F.col("destination_ip").alias("_key_target")] if rule.same_target else [])
    slim = stream.select(*(keys or [F.lit("").alias("_key")]), "ts", "event_id", F.unix_micros("ts").alias("_t"),
                         "attack_type", "source_ip", F.coalesce("stage_idx", F.lit(-1)).alias("stage_idx"),
                         F.coalesce("sev_idx", F.lit(-1)).alias("sev_idx"))
    names = [c for c in slim.columns if c.startswith("_key")]
    sliced = with_lookback(slim.withWatermark("ts", delay), "ts", C.rule_slice(rule) * STATE_SLICES, rule.window_seconds + 1e-6)
    return sliced.groupBy(*names, BUCKET).applyInPandasWithState(
        correlate, "event_id long, rule_id string, matched array<long>",
        "ids array<long>, times array<long>, types array<string>, sources array<string>, stages array<int>, sevs array<int>",
        "append", GroupStateTimeout.EventTimeTimeout)


# --- foreachBatch tables ------------------------------------------------------------------------

def profile_stream(stream: DataFrame, path: str, checkpoint: str, entity: str = "source_ip", interval: str | None = None,
                   alerts: str | None = None, min_obs: int = B.MIN_OBSERVATIONS):
    """Maintain mergeable behaviour profiles: one table generation per micro-batch.

    A generation holds the checkpoint and batch number that it was made from. A
    repeated batch of that checkpoint finds them there and does nothing, so a lost
    executor or a restart never counts a batch twice; batches of another checkpoint
    are merged whatever their numbers. Only the newest generations are kept.

    With a folder for ``alerts`` every record is held against the profile of its entity before the record joins it:
    stored batches first, then the records before it in its own batch. The alerts of a batch are written before its
    generation, under the name of checkpoint and batch, so a batch that is repeated replaces its own alerts.
    """
    from tarnwatch.sources.tables import prune_generations, read_generation

    mark = ["_checkpoint", "_batch"]

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored, number = read_generation(spark, path)
        done = stored.select(*mark).where(F.col("_checkpoint") == checkpoint).agg(F.max("_batch")).first()[0] if stored is not None else None
        if done is not None and done >= batch_id:
            return
        known, seen = (None if stored is None else stored.drop(*mark)), B.observations(batch, entity)
        if alerts:
            feed = hashlib.md5(checkpoint.encode()).hexdigest()
            B.record_alerts(seen, known, min_obs).write.mode("overwrite").parquet(f"{alerts}/feed={feed}/batch={batch_id}")
        parts = B.profile_parts(seen)
        merged = parts if known is None else B.merge_parts([known, parts])
        merged.withColumns({"_checkpoint": F.lit(checkpoint), "_batch": F.lit(batch_id).cast("long")}).write.mode(
            "overwrite").parquet(f"{path}/gen={number + 1:06d}")
        prune_generations(spark, path)

    return alert_actions(stream, merge, checkpoint, interval)


def stored_alerts(spark: SparkSession, alerts: str) -> DataFrame:
    """All alerts that profile streams wrote to a folder."""
    return spark.read.parquet(alerts).drop("feed", "batch")


def record_stats(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None):
    """Append one statistics row per micro-batch: processed, malicious, invalid and duration."""
    import time

    def note(batch: DataFrame, batch_id: int) -> None:
        begun = time.time()
        row = batch.agg(F.count("*").alias("processed"), count_if(F.col("is_malicious")).alias("malicious"),
                        count_if(F.col("is_malicious").isNull()).alias("errors")).first()
        batch.sparkSession.createDataFrame(
            [(batch_id, row["processed"], row["processed"] - row["errors"], row["malicious"], row["errors"],
              time.time() - begun)],
            "batch_id long, processed long, classified long, malicious long, errors long, seconds double"
        ).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return alert_actions(stream, note, checkpoint, interval)


def stream_stats(spark: SparkSession, path: str) -> DataFrame:
    """Totals over all recorded micro-batches."""
    return spark.read.parquet(path).agg(
        F.sum("processed").alias("processed"), F.sum("classified").alias("classified"),
        F.sum("malicious").alias("malicious"), F.sum("errors").alias("errors"), F.avg("seconds").alias("mean_batch_seconds"))
