"""Writing and reading the Parquet tables that hold state between runs."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwatch.operators.features import behavior_vector


def latest_rows(versions: list[DataFrame], keys: list[str], version: str) -> DataFrame:
    """Latest row per key over several inputs; among equal versions the later input wins.

    ``max_by`` keeps one row per key during the partial aggregation, so a key
    with very many versions never reaches one task as a whole.
    """
    tagged = [df.withColumn("_input", F.lit(i)) for i, df in enumerate(versions)]
    both = reduce(lambda a, b: a.unionByName(b), tagged)
    others = [c for c in versions[0].columns if c not in keys]
    newest = both.groupBy(*keys).agg(
        F.max_by(F.struct(*others), F.struct(F.col(version), F.col("_input"))).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others]).select(*versions[0].columns)


def upsert(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], version: str) -> str:
    """Insert-or-replace into a versioned table folder; returns the folder just written.

    A new generation is written next to the old one, so a job that dies half-way
    leaves the current generation readable and the upsert can simply be repeated.
    """
    current, number = read_generation(spark, path)
    merged = latest_rows([current, incoming] if current is not None else [incoming], keys, version)
    target = f"{path}/gen={number + 1:06d}"
    merged.write.mode("overwrite").parquet(target)
    return target


def _generations(spark: SparkSession, path: str) -> list[int]:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    done = []
    for status in fs.listStatus(hadoop):
        name = status.getPath().getName()
        marker = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("gen=") and fs.exists(marker):
            done.append(int(name.split("=")[1]))
    return sorted(done)


def read_generation(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """Newest complete generation of an upserted table and its number (0 when there is none)."""
    done = _generations(spark, path)
    if not done:
        return None, 0
    return spark.read.parquet(f"{path}/gen={done[-1]:06d}"), done[-1]


def prune_generations(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Drop all but the newest ``keep`` complete generations; returns the dropped numbers."""
    old = _generations(spark, path)[:-keep] if keep else []
    for number in old:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/gen={number:06d}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return old


def prediction_log_rows(predictions: DataFrame, traffic: DataFrame) -> DataFrame:
    fields = ["record_id", "source_ip", "destination_ip", "source_port", "destination_port", "protocol",
              "packet_size", "duration"]
    extra = ["features"] if "features" in traffic.columns else []
    return predictions.join(traffic.select(*fields, *extra), "record_id").withColumn("date", F.to_date("ts"))


def append_prediction_log(predictions: DataFrame, traffic: DataFrame, path: str) -> None:
    """Append predictions with their traffic fields, partitioned by date."""
    prediction_log_rows(predictions, traffic).write.mode("append").partitionBy("date").parquet(path)


def observation_rows(traffic: DataFrame, entity: str = "source_ip") -> DataFrame:
    return traffic.select(
        F.col(entity).alias("entity_id"), F.lit(entity).alias("entity_type"), "ts",
        behavior_vector().alias("observation"), F.to_date("ts").alias("date"))


def append_observations(traffic: DataFrame, path: str, entity: str = "source_ip") -> None:
    observation_rows(traffic, entity).write.mode("append").partitionBy("date").parquet(path)


def read_observations(spark: SparkSession, path: str, start: datetime, end: datetime) -> DataFrame:
    """Observations in a closed time range; the date filter prunes partitions."""
    return spark.read.parquet(path).where(
        F.col("date").between(F.lit(start.date()), F.lit(end.date()))
        & F.col("ts").between(F.lit(start), F.lit(end)))


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """One JSON folder per section; maps and arrays keep their structure."""
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def read_report(spark: SparkSession, path: str, schemas: dict[str, object]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """User export as CSV with header or JSON lines, written in parallel parts."""
    if fmt == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unsupported export format {fmt!r}")
