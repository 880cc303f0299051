"""Rule files and indicator lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_FILE_SCHEMA = """rules array<struct<rule_id: string, name: string, description: string, severity: string,
  rule_type: string, pattern: string, metadata: map<string,string>, enabled: boolean>>"""
RULE_SCHEMA = ("rule_id string, name string, description string, severity string, rule_type string, "
               "pattern string, metadata map<string,string>, enabled boolean")


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_rules_json(spark: SparkSession, path: str, family: str | None = None) -> DataFrame:
    """``{"rules": [...]}`` to rule rows in file order; a missing file means no rules.

    ``family`` is the family of rules that state none; without it such rules are an error when read.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], RULE_SCHEMA)
    raw = spark.read.schema(RULE_FILE_SCHEMA).json(path, multiLine=True)
    rules = raw.select(F.posexplode("rules").alias("_pos", "r")).orderBy("_pos").select("r.*")
    return rules.withColumns({
        "rule_type": F.coalesce("rule_type", F.lit(family)) if family else F.coalesce("rule_type", F.raise_error(F.concat(
            F.lit("no rule_type and no family given for rule "), F.coalesce("rule_id", F.lit("without id")))).cast("string")),
        "metadata": F.coalesce("metadata", F.expr("CAST(map() AS map<string,string>)")),
        "enabled": F.coalesce("enabled", F.lit(True))})


def indicator_lines(lines: DataFrame, feed: bool = False, value: str = "value") -> DataFrame:
    """Trimmed entries of a text list without blanks and comments; feeds also use ``;`` comments."""
    entry = lines.select(F.trim(F.col(value)).alias("value"))
    return entry.where((F.length("value") > 0) & ~F.col("value").rlike("^[#;]" if feed else "^#"))


def read_indicators(spark: SparkSession, path: str, kind: str = "ip", feed: bool = False) -> DataFrame:
    return indicator_lines(spark.read.text(path), feed).select(
        F.col("value").alias("indicator"), F.lit(kind).alias("indicator_type")).distinct()
