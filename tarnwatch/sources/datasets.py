"""Readers for labelled intrusion datasets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwatch import constants as K
from tarnwatch.operators.quality import clean_column_names, load_stats, replace_infinite, standardize_target
from tarnwatch.sources.rules import path_exists


class DataLoadError(Exception):
    """A dataset could not be read or failed its schema check."""


def _nsl_schema(columns: int) -> T.StructType:
    fields = [T.StructField(c, T.StringType() if c in K.NSL_KDD_TEXT else T.DoubleType()) for c in K.NSL_KDD_FEATURES]
    fields.append(T.StructField("attack_type", T.StringType()))
    if columns == len(fields) + 1:
        fields.append(T.StructField("difficulty_score", T.IntegerType()))
    elif columns != len(fields):
        raise DataLoadError(f"Unexpected number of columns: {columns}")
    return T.StructType(fields)


def read_nsl_kdd(spark: SparkSession, path: str) -> DataFrame:
    """Header-less CSV of 41 features, the label and optionally a difficulty score."""
    first = spark.read.text(path).where(F.length(F.trim("value")) > 0).limit(1).collect()
    if not first:
        raise DataLoadError(f"No data in {path}")
    schema = _nsl_schema(len(first[0]["value"].split(",")))
    df = spark.read.schema(schema).csv(path, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.withColumn("attack_type", F.regexp_replace("attack_type", r"\.$", ""))


def read_cicids(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """CSV with messy headers: names cleaned, label lower-cased, infinities as NULL."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    named = clean_column_names(standardize_target(raw.toDF(*[c.strip() for c in raw.columns])))
    numeric = [c for c in named.columns if c not in ("label", "flow_id", "source_ip", "destination_ip", "src_ip", "dst_ip",
                                                     "timestamp", "protocol_name")]
    typed = named.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in numeric})
    if "label" in typed.columns:
        typed = typed.withColumn("label", F.lower(F.trim("label")))
    out = replace_infinite(typed)
    return out.limit(max_rows) if max_rows else out


def safe_load(reader: Callable[[SparkSession, str], DataFrame], spark: SparkSession, path: str,
              check: Callable[[DataFrame], None] | None = None, with_stats: bool = False):
    """Run a reader behind path, emptiness and schema checks; errors carry the path."""
    if not path_exists(spark, path):
        raise DataLoadError(f"Path does not exist: {path}")
    try:
        df = reader(spark, path)
        if df.isEmpty():
            raise DataLoadError(f"No rows in {path}")
        if check is not None:
            check(df)
    except DataLoadError:
        raise
    except Exception as error:  # noqa: BLE001
        raise DataLoadError(f"Failed to load {path}: {error}") from error
    return (df, load_stats(df)) if with_stats else df
