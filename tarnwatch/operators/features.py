"""Per-record features: no shuffle, everything inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions import net
from tarnwatch.functions.columns import all_of, lookup
from tarnwatch.functions.text import confidence_bin


def basic_features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "packet_size": F.col("packet_size").cast("double"),
        "duration": F.col("duration").cast("double"),
        "protocol_encoded": net.flow_protocol_code("protocol")})


def flag_features(df: DataFrame) -> DataFrame:
    return df.withColumns({f"flag_{f}": net.has_flag("flags", f) for f in K.FLOW_FLAGS})


def port_features(df: DataFrame) -> DataFrame:
    return df.withColumns({"src_port_category": net.port_category("source_port"),
                           "dst_port_category": net.port_category("destination_port")})


def time_features(df: DataFrame) -> DataFrame:
    return df.withColumns({"hour_of_day": F.hour("ts").cast("double"),
                           "day_of_week": F.weekday("ts").cast("double")})


def tcp_flags(df: DataFrame, bits: str = "flag_bits") -> DataFrame:
    return df.withColumn("tcp_flags", net.decode_tcp_flags(bits))


def length_features(df: DataFrame, ihl: str = "ihl") -> DataFrame:
    """Header length from the IHL field (40 when absent) and what is left as payload."""
    header = F.coalesce(F.col(ihl) * 4, F.lit(40))
    return df.withColumns({"header_length": header, "payload_length": F.col("packet_size") - header})


def built_in_features() -> dict[str, Column]:
    """Behaviour features every record has."""
    return {
        "packet_size": F.col("packet_size").cast("double"),
        "duration": F.col("duration").cast("double"),
        "destination_port": F.col("destination_port").cast("double"),
        "source_port": F.col("source_port").cast("double"),
        "protocol_numeric": net.behavior_protocol_number("protocol"),
        "hour_of_day": F.hour("ts").cast("double"),
        "day_of_week": F.weekday("ts").cast("double"),
        "flags_count": F.size("flags").cast("double"),
    }


def behavior_vector(extra: str | None = "features") -> Column:
    """Feature map of a record; entries of the open map win over built-in ones."""
    built_in = F.create_map(*[x for name, value in built_in_features().items() for x in (F.lit(name), value)])
    if extra is None:
        return built_in
    given = F.coalesce(F.col(extra), F.expr("map()").cast("map<string,double>"))
    kept = F.map_filter(built_in, lambda k, v: ~F.map_contains_key(given, k))
    return F.map_concat(kept, given)


def behavior_features(df: DataFrame, extra: str | None = "features") -> DataFrame:
    return df.withColumn("behavior", behavior_vector(extra))


def filter_traffic(df: DataFrame, protocols=("TCP", "UDP", "ICMP"), ipv6: bool = True,
                   predicate: Column | str | None = None) -> DataFrame:
    """Records of supported protocols and IP versions that satisfy the user predicate."""
    conditions = [F.upper("protocol").isin(*[p.upper() for p in protocols])]
    if not ipv6:
        conditions.append(~F.col("source_ip").contains(":") & ~F.col("destination_ip").contains(":"))
    if predicate is not None:
        conditions.append(F.expr(predicate) if isinstance(predicate, str) else predicate)
    return df.where(all_of(conditions))


def confidence_counts(df: DataFrame) -> DataFrame:
    """Rows per confidence bin; all six bins are always present."""
    counted = df.groupBy(confidence_bin("confidence_score").alias("bin")).agg(F.count("*").alias("n"))
    names = [name for _, name in K.CONFIDENCE_BINS] + [K.LOWEST_CONFIDENCE_BIN]
    empty = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("bin"),
                                            F.lit(0).cast("long").alias("n"))
    return counted.unionByName(empty).groupBy("bin").agg(F.sum("n").alias("n"))


def attack_stage(attack_type) -> Column:
    return lookup(attack_type, K.ATTACK_STAGE)


def stage_index(stage) -> Column:
    return lookup(stage, {name: i for i, name in enumerate(K.KILL_CHAIN_STAGES)})
