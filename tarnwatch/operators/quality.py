"""Schema checks, data-quality reports and cleaning of labelled datasets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwatch import constants as K
from tarnwatch.functions import net
from tarnwatch.functions.columns import count_if, lookup, ratio
from tarnwatch.operators.quantiles import exact_quantiles
from tarnwatch.operators.scan import range_ranks, running
from tarnwatch.session import cut


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def is_missing(field: T.StructField) -> Column:
    """NULL, or NaN for floating columns."""
    c = F.col(f"`{field.name}`")
    return c.isNull() | F.isnan(c) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else c.isNull()


# --- schema helpers --------------------------------------------------------------

def clean_names(names: list[str]) -> list[str]:
    """Lower-case snake names; empty ones become ``column_i``; repeats get ``_1, _2, ...``."""
    taken: set[str] = set()
    out = []
    for i, name in enumerate(names):
        base = re.sub(r"_+", "_", re.sub(r"[^\w]", "_", str(name).strip())).strip("_").lower()
        base = base or f"column_{i}"
        unique, n = base, 0
        while unique in taken:
            n += 1
            unique = f"{base}_{n}"
        taken.add(unique)
        out.append(unique)
    return out


def clean_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def standardize_features(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in mapping.items() if a in df.columns})


def standardize_target(df: DataFrame) -> DataFrame:
    """Rename the first known target column to ``label``."""
    found = next((c for c in K.TARGET_ALIASES if c in df.columns), None)
    return df.withColumnRenamed(found, "label") if found else df


def validate_required_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def validate_data_types(df: DataFrame, expected: dict[str, str]) -> list[str]:
    """Warnings for columns that are not of the expected kind (numeric / categorical)."""
    kinds = {"numeric": set(numeric_columns(df)), "categorical": set(text_columns(df))}
    return [f"column {c} is not {kind}" for c, kind in expected.items()
            if c in df.columns and c not in kinds.get(kind, set(df.columns))]


def validate_dataset_schema(df: DataFrame, dataset: str) -> None:
    """Target column present and enough known feature columns."""
    known, target, share = {
        "nsl_kdd": (K.NSL_KDD_FEATURES, "attack_type", 0.8),
        "cicids": (K.CICIDS_FEATURES, "label", 0.25)}[dataset]
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' not found")
    present = sum(c in df.columns for c in known)
    if present < share * len(known):
        raise ValueError(f"Insufficient features: {present} of {len(known)}")


# --- missing and invalid values ----------------------------------------------------

def missing_counts(df: DataFrame) -> DataFrame:
    """(column, missing, percent) in one pass."""
    fields = df.schema.fields
    counts = df.agg(F.count("*").alias("_n"), *[count_if(is_missing(f)).alias(f.name) for f in fields])
    rows = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"`{f.name}`").alias("missing"),
                              ratio(F.col(f"`{f.name}`") * 100.0, F.col("_n")).alias("percent")) for f in fields])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) for text columns, combined map-side before the shuffle."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
                     for c in columns])
    return (df.select(F.explode(rows).alias("r")).select("r.*").where("value IS NOT NULL")
            .groupBy("column", "value").agg(F.count("*").alias("n")))


def modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent value per text column, the smallest one among equals."""
    if not columns:
        return {}
    best = value_counts(df, columns).groupBy("column").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("a"), F.col("value").alias("b"))).alias("value"))
    return {r["column"]: r["value"] for r in best.collect()}


def handle_missing(df: DataFrame, strategy: str = "log") -> DataFrame:
    """``log`` returns counts per column, ``drop`` drops rows, ``fill`` uses median / mode."""
    if strategy == "log":
        return missing_counts(df).where("missing > 0")
    if strategy == "drop":
        return df.dropna()
    if strategy != "fill":
        raise ValueError(f"unknown strategy {strategy!r}")
    gaps = {r["column"] for r in missing_counts(df).where("missing > 0").collect()}
    clean = df.select(*[F.when(~is_missing(f), F.col(f"`{f.name}`")).alias(f.name) if f.name in gaps
                        else F.col(f"`{f.name}`") for f in df.schema.fields])
    medians = exact_quantiles(clean, [c for c in numeric_columns(df) if c in gaps], [0.5])
    common = modes(clean, [c for c in text_columns(df) if c in gaps])
    fill = {c: q[0] for c, q in medians.items() if q[0] is not None}
    texts = {c: common.get(c) or "unknown" for c in text_columns(df) if c in gaps}
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in fill:
            whole = isinstance(f.dataType, T.IntegralType) and float(fill[f.name]).is_integer()
            c = F.coalesce(c, F.lit(fill[f.name]).cast(f.dataType if whole else "double"))
        elif f.name in texts:
            c = F.coalesce(c, F.lit(texts[f.name]))
        out.append(c.alias(f.name))
    return clean.select(*out)


def replace_infinite(df: DataFrame) -> DataFrame:
    """Infinite and NaN values of floating columns become NULL."""
    fixed = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f"`{f.name}`")
            bad = c.isin(float("inf"), float("-inf")) | F.isnan(c)
            fixed[f.name] = F.when(~bad, c)
    return df.withColumns(fixed) if fixed else df


def check_ranges(df: DataFrame) -> DataFrame:
    """(column, negatives) for length, count and duration columns that hold negatives."""
    names = [c for c in numeric_columns(df) if any(w in c for w in ("length", "count", "duration"))]
    counts = df.agg(*[count_if(F.col(f"`{c}`") < 0).alias(c) for c in names])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("negatives")) for c in names])
    return counts.select(F.explode(rows).alias("r")).select("r.*").where("negatives > 0")


def validate_packets(df: DataFrame, ipv6: bool = True) -> DataFrame:
    """Add ``errors``: the reasons a packet is rejected; empty means valid."""
    def port_ok(name):
        return F.coalesce(F.col(name).between(0, 65535), F.lit(False))

    checks = [(net.is_valid_ip("source_ip", ipv6), "source_ip"),
              (net.is_valid_ip("destination_ip", ipv6), "destination_ip"),
              (port_ok("source_port"), "source_port"), (port_ok("destination_port"), "destination_port"),
              (F.coalesce(F.col("packet_size") >= 0, F.lit(False)), "packet_size"),
              (F.coalesce(F.col("duration") >= 0, F.lit(False)), "duration")]
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for ok, name in checks])))


# --- reports -----------------------------------------------------------------------

def duplicate_count(df: DataFrame) -> DataFrame:
    """(records, duplicates): rows beyond the first of each distinct row."""
    groups = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("records"),
                      F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def load_stats(df: DataFrame) -> DataFrame:
    """(rows, nulls, duplicates, duplicate_pct): everything follows from the distinct-row groups."""
    groups = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("_n"))
    nulls = sum((F.when(is_missing(f), 1).otherwise(0) for f in df.schema.fields), F.lit(0))
    totals = groups.agg(F.sum("_n").alias("rows"), F.sum(nulls * F.col("_n")).alias("nulls"),
                        F.sum(F.col("_n") - 1).alias("duplicates"))
    return totals.withColumn("duplicate_pct", ratio(F.col("duplicates") * 100.0, F.col("rows")))


def quality_report(df: DataFrame) -> DataFrame:
    """(metric, item, value) rows: sizes, missing, duplicates, constant and high-cardinality columns.

    A column is constant iff its minimum equals its maximum, so distinct counts
    are only computed for text columns.
    """
    fields, texts = df.schema.fields, text_columns(df)
    aggs = [F.count("*").alias("_n")]
    for i, f in enumerate(fields):
        c = F.when(~is_missing(f), F.col(f"`{f.name}`"))
        aggs += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    row = df.agg(*aggs)
    per_column = F.array(*[F.struct(
        F.lit(f.name).alias("item"), (F.col("_n") - F.col(f"n{i}")).alias("missing"),
        ((F.col(f"n{i}") == 0) | (F.col(f"lo{i}") == F.col(f"hi{i}"))).alias("constant"))
        for i, f in enumerate(fields)])
    totals = row.select(F.explode(F.array(
        F.struct(F.lit("total_records").alias("metric"), F.lit("").alias("item"), F.col("_n").alias("value")),
        F.struct(F.lit("total_features").alias("metric"), F.lit("").alias("item"),
                 F.lit(len(fields)).cast("long").alias("value")),
        F.struct(F.lit("missing_values").alias("metric"), F.lit("").alias("item"),
                 F.aggregate(per_column, F.lit(0).cast("long"), lambda a, x: a + x["missing"]).alias("value")),
    )).alias("e")).select("e.*")
    constant = row.select(F.explode(per_column).alias("e")).where("e.constant").select(
        F.lit("constant_column").alias("metric"), "e.item", F.lit(1).cast("long").alias("value"))
    duplicates = duplicate_count(df).select(F.lit("duplicate_records").alias("metric"), F.lit("").alias("item"),
                                            F.col("duplicates").alias("value"))
    out = totals.unionByName(constant).unionByName(duplicates)
    if texts:
        total = df.groupBy().agg(F.count("*").alias("_n")).first()["_n"]
        distinct = value_counts(df, texts).groupBy(F.col("column").alias("item")).agg(F.count("*").alias("value"))
        out = out.unionByName(distinct.where(F.col("value") > 0.5 * total).select(
            F.lit("high_cardinality_column").alias("metric"), "item", "value"))
    return out


def attack_category(label, dataset: str) -> Column:
    table = {"nsl_kdd": K.NSL_KDD_CATEGORIES, "cicids": K.CICIDS_CATEGORIES}[dataset]
    flat = {name: category for category, names in table.items() for name in names}
    c = F.col(label) if isinstance(label, str) else label
    return lookup(F.lower(F.trim(c)), flat, "unknown")


def add_attack_category(df: DataFrame, dataset: str, target: str | None = None) -> DataFrame:
    target = target or {"nsl_kdd": "attack_type", "cicids": "label"}[dataset]
    return df.withColumn("attack_category", attack_category(target, dataset)) if target in df.columns else df


def dataset_statistics(df: DataFrame, target: str, category: str | None = None) -> DataFrame:
    """(section, item, n): size, label and category distributions, missing per column, column kinds."""
    def row(section, item, n):
        return F.struct(F.lit(section).alias("section"), F.lit(item).alias("item"), n.cast("long").alias("n"))

    fields = df.schema.fields
    kinds = [("numeric", c) for c in numeric_columns(df)] + [("categorical", c) for c in text_columns(df)]
    counts = df.agg(F.count("*").alias("_n"), *[count_if(is_missing(f)).alias(f.name) for f in fields])
    entries = [row("size", "records", F.col("_n")), row("size", "features", F.lit(len(fields) - 1))]
    entries += [row("missing", f.name, F.col(f"`{f.name}`")) for f in fields]
    entries += [row(kind, c, F.lit(1)) for kind, c in kinds if c != target]
    out = counts.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    by_label = df.groupBy(F.lit("label").alias("section"), F.col(target).alias("item")).agg(F.count("*").alias("n"))
    out = out.unionByName(by_label)
    if category:
        out = out.unionByName(df.groupBy(F.lit("category").alias("section"), F.col(category).alias("item")).agg(
            F.count("*").alias("n")))
    return out


def preprocess_for_ml(df: DataFrame, dataset: str) -> DataFrame:
    """Category column, no difficulty column, no infinities, no gaps."""
    out = add_attack_category(df, dataset)
    out = replace_infinite(out.drop("difficulty_score"))
    return handle_missing(out, "fill")


# --- sampling ------------------------------------------------------------------------

def order_hash(id_col: str, seed: int) -> Column:
    return F.xxhash64(F.col(id_col), F.lit(seed))


def rank_in_class(df: DataFrame, label: str, id_col: str, seed: int, name: str = "_rank") -> DataFrame:
    """1-based random (but repeatable) rank of every row inside its class.

    The random order is cut into 65536 hash ranges, so no class is ordered in one task.
    """
    hashed = df.withColumn("_h", order_hash(id_col, seed))
    ranked = running(hashed, [label], ["_h", id_col], F.shiftright(F.col("_h"), 48), {name: ("count", F.lit(1))})
    return ranked.drop("_h")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """(_label, _n): rows of every class; a table, as there may be any number of classes."""
    return df.groupBy(F.col(f"`{label}`").alias("_label")).agg(F.count("*").alias("_n"))


def per_class(df: DataFrame, label: str, classes: DataFrame) -> DataFrame:
    """``df`` with the columns of its row in ``classes``; AQE sends small class tables to all tasks and splits hot classes of large ones."""
    return df.join(classes, F.col(f"`{label}`").eqNullSafe(F.col("_label"))).drop("_label")


def sample_rows(df: DataFrame, n: int, id_col: str, stratify: str | None = None, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows; with ``stratify`` the classes keep their shares (largest remainder)."""
    if stratify is None:
        total = df.count()
        if n >= total:
            return df
        ranked = rank_in_class(df.withColumn("_all", F.lit(0)), "_all", id_col, seed)
        return ranked.where(F.col("_rank") <= n).drop("_rank", "_all")
    counts = cut(class_counts(df, stratify))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    if n >= total:
        return df
    exact = F.lit(n) * F.col("_n") / F.lit(float(total))
    quotas = counts.withColumns({"_quota": F.floor(exact), "_behind": F.floor(exact) - exact, "_name": F.col("_label").cast("string")})
    spare = n - quotas.agg(F.sum("_quota")).first()[0]
    place = range_ranks(quotas.withColumn("_all", F.lit(0)), ["_all"], ["_behind", "_name", "_label"], "_place")
    quotas = place.select("_label", (F.col("_quota") + (F.col("_place") <= spare).cast("long")).alias("_quota"))
    ranked = rank_in_class(df, stratify, id_col, seed)
    return per_class(ranked, stratify, quotas).where(F.col("_rank") <= F.col("_quota")).drop("_rank", "_quota")
