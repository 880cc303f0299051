"""Feature preparation: encoding, scaling, imputation, cleaning and class balancing."""

from __future__ import annotations

import itertools
import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwatch.functions.columns import all_of, count_if, lookup, safe_corr, without_nan
from tarnwatch.operators.neighbours import nearest_sites
from tarnwatch.operators.quality import (class_counts, missing_counts, numeric_columns, per_class, rank_in_class,
                                         text_columns, value_counts)
from tarnwatch.operators.quantiles import exact_quantiles
from tarnwatch.operators.scan import range_ranks
from tarnwatch.session import cut, kept_table

#: Categories that are kept with the encoder and become expressions of the plan; columns with more have a dictionary table.
MAX_INLINE = 64
#: Columns that one-hot encoding may add for one column; every one is a column of the plan.
MAX_ONEHOT = 10_000
#: Bytes of a dictionary that is sent to all tasks; larger ones are joined by value.
MAX_BROADCAST = 32 << 20


class Fitted:
    """Fitted state is a small plain mapping, saved as JSON text through Spark, so any shared folder will do."""

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, path: str):
        return cls(**json.loads(SparkSession.getActiveSession().read.text(path).first()["value"]))


# --- encoding ------------------------------------------------------------------------

@dataclass
class Encoder(Fitted):
    """Categories per column (sorted) and how each column is encoded.

    A column with more than ``MAX_INLINE`` categories has its codes in a table (column, value, code) at
    ``dictionary`` instead, and its size in bytes in ``sizes``. Code n is the n-th value in order either way.
    """

    categories: dict[str, list[str]]
    strategies: dict[str, str]
    drop_first: bool = False
    handle_unknown: str = "ignore"
    dictionary: str | None = None
    sizes: dict[str, int] = field(default_factory=dict)

    def save(self, path: str) -> None:
        """The fitted text and, next to it, a copy of the dictionary."""
        kept = self
        if self.dictionary:
            kept = replace(self, dictionary=f"{path}/dictionary")
            SparkSession.getActiveSession().read.parquet(self.dictionary).write.mode("overwrite").parquet(kept.dictionary)
        Fitted.save(kept, f"{path}/fitted")

    @classmethod
    def load(cls, path: str) -> Encoder:
        return cls(**json.loads(SparkSession.getActiveSession().read.text(f"{path}/fitted").first()["value"]))

    def _name(self, column: str, value: str) -> str:
        return f"{column}_{value}"

    def _codes(self, df: DataFrame, column: str) -> DataFrame:
        """(_v, _c): the column's dictionary, sent to all tasks only if its bytes are few."""
        codes = df.sparkSession.read.schema("column string, value string, code long").parquet(self.dictionary).where(
            F.col("column") == column).select(F.col("value").alias(f"_v_{column}"), F.col("code").alias(f"_c_{column}"))
        return F.broadcast(codes) if self.sizes[column] <= MAX_BROADCAST else codes

    def feature_names(self, df: DataFrame) -> list[str]:
        return self.transform(df).columns

    def transform(self, df: DataFrame) -> DataFrame:
        out, joined = [], df
        unknown = lambda name: F.raise_error(F.concat(F.lit(f"unknown category in {name}: "), F.coalesce(F.col(f"`{name}`"), F.lit("NULL"))))
        for name in df.columns:
            if name not in self.strategies:
                out.append(F.col(f"`{name}`"))
                continue
            value = F.col(f"`{name}`")
            if name in self.sizes:
                # NULL has no code; it is dealt out, so that many of them do not meet in one task
                key = F.coalesce(value, F.concat(F.lit("\0"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(4096)).cast("string")))
                joined = joined.join(self._codes(df, name), key == F.col(f"`_v_{name}`"), "left")
                code = F.when(value.isNotNull(), F.col(f"`_c_{name}`").cast("int"))
                out.append(F.coalesce(code, unknown(name).cast("int") if self.handle_unknown == "error" else F.lit(-1)).alias(name))
                continue
            known = self.categories[name]
            if self.handle_unknown == "error":
                value = F.when(value.isin(*known), value).otherwise(unknown(name))
            if self.strategies[name] == "label":
                out.append(lookup(value, {v: i for i, v in enumerate(known)}, -1).alias(name))
            else:
                out += [F.coalesce((value == v).cast("int"), F.lit(0)).alias(self._name(name, v))
                        for v in known[1 if self.drop_first else 0:]]
        return joined.select(*out)

    def inverse(self, df: DataFrame) -> DataFrame:
        """Original text columns from encoded ones; unknown values come back as NULL."""
        out, joined = {}, df
        for name in self.strategies:
            if name in self.sizes:
                joined = joined.join(self._codes(df, name), F.col(f"`{name}`") == F.col(f"`_c_{name}`"), "left")
                out[name] = F.col(f"`_v_{name}`")
                continue
            known = self.categories[name]
            if self.strategies[name] == "label":
                out[name] = F.try_element_at(F.array(*map(F.lit, known)),
                                             F.when(F.col(name) >= 0, F.col(name) + 1).cast("int"))
            else:
                shown = known[1 if self.drop_first else 0:]
                parts = [F.when(F.col(f"`{self._name(name, v)}`") == 1, F.lit(v)) for v in shown]
                rest = F.lit(known[0]) if self.drop_first and known else F.lit(None).cast("string")
                out[name] = F.coalesce(*parts, rest)
        hidden = [self._name(n, v) for n, ks in self.categories.items()
                  if self.strategies[n] == "onehot" for v in ks]
        hidden += [f"_{x}_{n}" for n in self.sizes for x in "vc"]
        return joined.withColumns(out).drop(*[h for h in hidden if h not in out])


def fit_encoder(df: DataFrame, strategy: str = "auto", max_onehot: int = 10, columns: list[str] | None = None,
                handle_unknown: str = "ignore", drop_first: bool = False) -> Encoder:
    """Choose an encoding per text column and number its categories in order, however many there are.

    Categories that become expressions of the plan come to the driver; those of larger columns are numbered by a
    range-partitioned prefix count and stay in a table. Only one-hot encoding has a limit, ``MAX_ONEHOT`` columns.
    """
    columns = columns or text_columns(df)
    counted = cut(value_counts(df, columns).select("column", "value"))
    sizes = {r["column"]: r for r in counted.groupBy("column").agg(
        F.count("*").alias("n"), F.sum(F.length("value") * 3 + 24).alias("bytes")).collect()}
    rows = {c: sizes[c]["n"] if c in sizes else 0 for c in columns}
    chosen = {c: strategy if strategy != "auto" else ("onehot" if n <= max_onehot else "label") for c, n in rows.items()}
    wide = [c for c in columns if chosen[c] == "onehot" and rows[c] > MAX_ONEHOT]
    if wide:
        raise ValueError(f"one-hot encoding of {wide} would add more than {MAX_ONEHOT} columns; use strategy='label'")
    large = [c for c in columns if chosen[c] == "label" and rows[c] > MAX_INLINE]
    found: dict[str, list[str]] = {c: [] for c in columns if c not in large}
    for r in counted.where(~F.col("column").isin(*large)).collect():  # MAX_ONEHOT values of a column at most
        found[r["column"]].append(r["value"])
    place = None
    if large:
        codes = range_ranks(counted.where(F.col("column").isin(*large)), ["column"], ["value"], "code")
        place = kept_table(codes.select("column", "value", (F.col("code") - 1).alias("code")), "dictionary")
    return Encoder({c: sorted(v) for c, v in found.items()}, chosen, drop_first, handle_unknown, place,
                   {c: sizes[c]["bytes"] for c in large})


# --- scaling and imputation ------------------------------------------------------------

@dataclass
class Scaler(Fitted):
    """``(x - center) / scale * span + low``; a zero scale marks a constant column."""

    center: dict[str, float]
    scale: dict[str, float]
    span: float = 1.0
    low: float = 0.0

    def transform(self, df: DataFrame) -> DataFrame:
        def scaled(c):
            if self.scale[c] == 0:
                return F.when(F.col(f"`{c}`").isNotNull(), F.lit(self.low))
            return (F.col(f"`{c}`") - self.center[c]) / self.scale[c] * self.span + self.low
        return df.withColumns({c: scaled(c) for c in self.center})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (F.col(f"`{c}`") - self.low) / self.span * self.scale[c] + self.center[c] for c in self.center})


def fit_scaler(df: DataFrame, kind: str = "standard", columns: list[str] | None = None,
               feature_range: tuple[float, float] = (0.0, 1.0)) -> Scaler:
    """standard: mean and population deviation; minmax: range; robust: median and IQR. Gaps (NULL, NaN) are left out."""
    columns = columns or numeric_columns(df)
    df = without_nan(df, columns)
    if kind == "standard":
        row = df.agg(*[f(F.col(f"`{c}`")).alias(f"{n}{i}") for i, c in enumerate(columns)
                       for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        return Scaler({c: row[f"m{i}"] or 0.0 for i, c in enumerate(columns)},
                      {c: row[f"s{i}"] or 0.0 for i, c in enumerate(columns)})
    if kind == "minmax":
        row = df.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns)
                       for n, f in (("a", F.min), ("b", F.max))]).first()
        return Scaler({c: row[f"a{i}"] or 0.0 for i, c in enumerate(columns)},
                      {c: (row[f"b{i}"] or 0.0) - (row[f"a{i}"] or 0.0) for i, c in enumerate(columns)},
                      span=feature_range[1] - feature_range[0], low=feature_range[0])
    if kind == "robust":
        q = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        return Scaler({c: v[1] or 0.0 for c, v in q.items()},
                      {c: (v[2] or 0.0) - (v[0] or 0.0) for c, v in q.items()})
    raise ValueError(f"Unsupported scaler type: {kind}")


def scaling_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean, std, min, max) in one pass."""
    aggs = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    row = without_nan(df, columns).agg(*[fn(F.col(f"`{c}`")).cast("double").alias(f"{n}{i}") for i, c in enumerate(columns)
                   for n, fn in aggs.items()])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{n}{i}").alias(n) for n in aggs])
                        for i, c in enumerate(columns)])
    return row.select(F.explode(entries).alias("e")).select("e.*")


def impute(df: DataFrame, strategy: str = "mean", fill_value: float = 0, columns: list[str] | None = None) -> DataFrame:
    columns = columns or numeric_columns(df)
    df = without_nan(df, columns)
    if strategy == "drop":
        out = df.dropna(subset=columns)
        if out.isEmpty():
            raise ValueError("All rows were dropped: every row has missing values")
        return out
    if strategy == "constant":
        values = {c: fill_value for c in columns}
    elif strategy == "mean":
        row = df.agg(*[F.avg(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        values = {c: row[i] for i, c in enumerate(columns)}
    elif strategy == "median":
        values = {c: q[0] for c, q in exact_quantiles(df, columns, [0.5]).items()}
    else:
        raise ValueError(f"Unsupported missing value strategy: {strategy}")
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(v)))
                           for c, v in values.items() if v is not None})


# --- cleaning ------------------------------------------------------------------------------

def high_missing_features(df: DataFrame, threshold: float = 0.5) -> list[str]:
    rows = missing_counts(df).where(F.col("percent") > threshold * 100).collect()
    return [c for c in df.columns if c in {r["column"] for r in rows}]


def top_value_shares(df: DataFrame) -> DataFrame:
    """(column, share): share of the most frequent non-missing value among all rows, by map-side combined value counts."""
    total = df.count()
    counted = value_counts(without_nan(df, numeric_columns(df)), df.columns)
    return counted.groupBy("column").agg((F.max("n") / F.lit(float(total or 1))).alias("share"))


def constant_features(df: DataFrame, threshold: float = 0.95) -> list[str]:
    rows = top_value_shares(df).where(F.col("share") >= threshold).collect()
    return [c for c in df.columns if c in {r["column"] for r in rows}]


def variances(df: DataFrame, columns: list[str] | None = None) -> dict[str, float | None]:
    columns = columns or numeric_columns(df)
    row = without_nan(df, columns).agg(*[F.var_samp(F.col(f"`{c}`")).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    return {c: row[i] for i, c in enumerate(columns)}


def low_variance_features(df: DataFrame, threshold: float = 0.0) -> list[str]:
    return [c for c, v in variances(df).items() if v is not None and v <= threshold]


def correlations(df: DataFrame, columns: list[str] | None = None, chunk: int = 150) -> dict[tuple[str, str], float]:
    """Pearson correlation of every column pair; rows with a gap in either column are left out."""
    columns = columns or numeric_columns(df)
    pairs = list(itertools.combinations(columns, 2))
    if len(pairs) > chunk and not any(r["missing"] for r in missing_counts(df.select(*columns)).collect()):
        vectors = VectorAssembler(inputCols=columns, outputCol="_v").transform(df).select("_v")
        matrix = Correlation.corr(vectors, "_v").first()[0].toArray()
        at = {c: i for i, c in enumerate(columns)}
        return {(a, b): float(matrix[at[a], at[b]]) for a, b in pairs}
    out = {}
    for lo in range(0, len(pairs), chunk):
        part = pairs[lo:lo + chunk]
        row = df.agg(*[safe_corr(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"r{i}") for i, (a, b) in enumerate(part)]).first()
        out.update({p: row[i] for i, p in enumerate(part)})
    return out


def correlated_features(df: DataFrame, threshold: float = 0.95) -> list[str]:
    """The later column of every pair whose correlation is beyond the threshold."""
    later = {b for (_, b), r in correlations(df).items() if r is not None and abs(r) > threshold}
    return [c for c in df.columns if c in later]


def outlier_bounds(df: DataFrame, method: str, threshold: float, columns: list[str] | None = None) -> dict:
    columns = columns or numeric_columns(df)
    df = without_nan(df, columns)
    if method == "zscore":
        row = df.agg(*[f(F.col(f"`{c}`")).alias(f"{n}{i}") for i, c in enumerate(columns)
                       for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        return {c: (row[f"m{i}"] - threshold * row[f"s{i}"], row[f"m{i}"] + threshold * row[f"s{i}"])
                for i, c in enumerate(columns) if row[f"s{i}"]}
    if method == "iqr":
        q = exact_quantiles(df, columns, [0.25, 0.75])
        return {c: (v[0] - threshold * (v[1] - v[0]), v[1] + threshold * (v[1] - v[0]))
                for c, v in q.items() if v[0] is not None}
    return {}


def remove_outliers(df: DataFrame, method: str = "zscore", threshold: float = 3.0) -> DataFrame:
    """Drop rows outside the bounds of any numeric column; an unknown method changes nothing."""
    bounds = outlier_bounds(df, method, threshold)
    return df.where(all_of([F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`")) | F.col(f"`{c}`").between(lo, hi)
                            for c, (lo, hi) in bounds.items()]))


@dataclass
class Cleaner(Fitted):
    """Columns to drop, with the reason, and outlier bounds, as fitted."""

    removed: dict[str, list[str]]
    bounds: dict[str, list[float]] = field(default_factory=dict)
    remove_duplicates: bool = True

    def transform(self, df: DataFrame) -> DataFrame:
        """Fitted columns are dropped; rows are left alone (no outlier or duplicate removal)."""
        gone = [c for names in self.removed.values() for c in names]
        return df.drop(*gone)


def fit_cleaner(df: DataFrame, missing: float = 0.5, constant: float = 0.95, variance: float = 0.0,
                correlation: float = 0.95, outliers: str = "none", outlier_threshold: float = 3.0,
                remove_duplicates: bool = True) -> tuple[Cleaner, DataFrame]:
    """Fit and clean: duplicates, sparse, constant, flat and redundant columns, then outlier rows."""
    if df.isEmpty():
        raise ValueError("Input DataFrame is empty")
    # several passes follow; the distinct rows are worked out once
    work = cut(df.dropDuplicates()) if remove_duplicates else df
    removed: dict[str, list[str]] = {}
    for reason, find in (("high_missing", lambda d: high_missing_features(d, missing)),
                         ("constant", lambda d: constant_features(d, constant)),
                         ("low_variance", lambda d: low_variance_features(d, variance)),
                         ("correlated", lambda d: correlated_features(d, correlation))):
        removed[reason] = find(work)
        work = work.drop(*removed[reason])
    bounds = outlier_bounds(work, outliers, outlier_threshold)
    cleaned = work.where(all_of([F.col(f"`{c}`").isNull() | F.col(f"`{c}`").between(lo, hi)
                                 for c, (lo, hi) in bounds.items()]))
    return Cleaner(removed, {c: list(b) for c, b in bounds.items()}, remove_duplicates), cleaned


def cleaning_statistics(original: DataFrame, cleaned: DataFrame) -> DataFrame:
    """(stage, rows, columns)."""
    def size(df, stage):
        return df.agg(F.lit(stage).alias("stage"), F.count("*").alias("rows"),
                      F.lit(len(df.columns)).cast("long").alias("columns"))
    return size(original, "before").unionByName(size(cleaned, "after"))


# --- class balancing ---------------------------------------------------------------------------

def class_targets(counts: DataFrame, strategy="auto", over: bool = True) -> DataFrame:
    """(_label, _n, _target) from (_label, _n): ``auto``, ``minority`` / ``majority``, a ratio, or explicit counts."""
    n = F.col("_n")
    smallest, largest = counts.agg(F.min("_n"), F.max("_n")).first()
    if isinstance(strategy, dict):
        target = F.coalesce(lookup("_label", strategy), n) if strategy else n
    elif over:
        target = {"auto": F.lit(largest), "minority": F.when(n == smallest, largest).otherwise(n)}.get(strategy)
        target = F.greatest(n, F.lit(int(strategy * (largest or 0)))) if target is None else target
    else:
        target = {"auto": F.lit(smallest), "majority": F.when(n == largest, smallest).otherwise(n)}.get(strategy)
        target = F.least(n, F.lit(int((smallest or 0) / strategy))) if target is None else target
    return counts.withColumn("_target", target.cast("long"))


#: Copies of one row that are made in a row; more are spread over tasks.
COPY_CHUNK = 10_000


def copied(df: DataFrame, times: str, name: str) -> DataFrame:
    """Every row as often as its column ``times`` says, numbered from 0 in ``name``; a row with very many copies is dealt out first."""
    few = df.where(F.col(times) <= COPY_CHUNK).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1)))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / COPY_CHUNK)))
    dealt = df.where(F.col(times) > COPY_CHUNK).withColumn("_chunk", chunk).repartition(
        int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_chunk")
    many = dealt.withColumn(name, F.explode(F.sequence(F.col("_chunk") * COPY_CHUNK, F.least((F.col("_chunk") + 1) * COPY_CHUNK, F.col(times)) - 1)))
    return few.unionByName(many.drop("_chunk")).drop(times)


def random_oversample(df: DataFrame, label: str, id_col: str, strategy="auto", seed: int = 42) -> DataFrame:
    """Repeat rows until every class has its target size; ``_copy`` 0 is the original row."""
    classes = class_targets(cut(class_counts(df, label)), strategy)
    whole = F.greatest(F.floor(F.col("_target") / F.col("_n")), F.lit(1))
    classes = classes.select("_label", whole.alias("_whole"), F.greatest(F.col("_target") - whole * F.col("_n"), F.lit(0)).alias("_extra"))
    ranked = per_class(rank_in_class(df, label, id_col, seed), label, classes)
    timed = ranked.withColumn("_times", F.col("_whole") + (F.col("_rank") <= F.col("_extra")).cast("long"))
    return copied(timed.drop("_whole", "_extra", "_rank"), "_times", "_copy")


def random_undersample(df: DataFrame, label: str, id_col: str, strategy="auto", seed: int = 42) -> DataFrame:
    """A random part of every class, as many rows as its target size."""
    classes = class_targets(cut(class_counts(df, label)), strategy, over=False).select("_label", "_target")
    ranked = per_class(rank_in_class(df, label, id_col, seed), label, classes)
    return ranked.where(F.col("_rank") <= F.col("_target")).drop("_rank", "_target")


def smote(df: DataFrame, label: str, id_col: str, columns: list[str], k: int = 5, strategy="auto",
          seed: int = 42) -> DataFrame:
    """Original rows plus synthetic ones between a row and one of its k nearest neighbours of the same class.

    Neighbours are exact at every size; distances are over columns divided by their deviation. Rows at one point are
    one another's neighbours at distance 0, and equal distances go by the random rank of the point's first row.
    Rows with a gap (NULL, NaN) in a column or without a class make nothing and are nobody's neighbour; a class of such
    rows alone stays as it is. The only row of a class is repeated.
    """
    base = df.select(id_col, label, *columns).withColumn("_synthetic", F.lit(False))
    whole = without_nan(df.select(id_col, label, *columns), columns).dropna(subset=[label, *columns])
    made_by = class_counts(whole, label).select(F.col("_label").alias("_l"), F.col("_n").alias("_whole"))
    classes = class_targets(cut(class_counts(df, label)), strategy).join(made_by, F.col("_label") == F.col("_l")).where("_target > _n").select(
        "_label", F.floor((F.col("_target") - F.col("_n")) / F.col("_whole")).alias("_each"), F.pmod(F.col("_target") - F.col("_n"), F.col("_whole")).alias("_rest"))
    classes = cut(classes)
    if classes.isEmpty():
        return base
    stats = whole.agg(*[F.stddev_pop(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    growing = whole.join(classes.select("_label"), F.col(f"`{label}`") == F.col("_label"), "left_semi")
    seeds = per_class(rank_in_class(growing, label, id_col, seed), label, classes)
    make = F.col("_each") + (F.col("_rank") <= F.col("_rest")).cast("long")
    sites = cut(seeds.withColumn("_make", make).groupBy(label, *columns).agg(
        F.min("_rank").alias("_first"), F.count("*").alias("_weight"), F.sum("_make").cast("long").alias("_make")))
    found = nearest_sites(sites, label, columns, {c: stats[i] or 0.0 for i, c in enumerate(columns)}, k)

    own = F.filter("near", lambda s: s["first"] == F.col("_first"))[0]["x"]
    others = F.slice(F.flatten(F.transform("near", lambda s: F.array_repeat(s["x"], F.least(
        s["weight"] - (s["first"] == F.col("_first")).cast("long"), F.lit(k)).cast("int")))), 1, k)
    copies = copied(found.select(label, "_first", "_make", own.alias("_own"), others.alias("_near")), "_make", "_copy")
    drawn = lambda n: F.xxhash64(F.lit(seed), F.lit(n), label, "_first", "_copy")
    other = F.when(F.size("_near") == 0, F.col("_own")).otherwise(F.try_element_at("_near", (F.pmod(drawn(0), F.greatest(F.size("_near"), F.lit(1))) + 1).cast("int")))
    part = F.shiftrightunsigned(drawn(1), 11) * F.lit(2.0 ** -53)
    made = copies.withColumns({"_other": other, "_part": part}).select(
        F.lit(None).cast(df.schema[id_col].dataType).alias(id_col), label,
        *[(F.col("_own")[i] + F.col("_part") * (F.col("_other")[i] - F.col("_own")[i])).alias(c) for i, c in enumerate(columns)],
        F.lit(True).alias("_synthetic"))
    return base.withColumns({c: F.col(c).cast("double") for c in columns}).unionByName(made)


def imbalance_ratio(df: DataFrame, label: str) -> DataFrame:
    """(classes, smallest, largest, ratio); the ratio is 1 for a single class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("classes"), F.min("n").alias("smallest"), F.max("n").alias("largest"),
                      (F.min("n") / F.max("n")).alias("ratio"))


def is_imbalanced(df: DataFrame, label: str, threshold: float = 0.5) -> bool:
    return imbalance_ratio(df, label).first()["ratio"] < threshold


def distribution(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """(label, before, after) class sizes."""
    a = before.groupBy(label).agg(F.count("*").alias("before"), F.lit(0).cast("long").alias("after"))
    b = after.groupBy(label).agg(F.lit(0).cast("long").alias("before"), F.count("*").alias("after"))
    return a.unionByName(b).groupBy(label).agg(F.sum("before").alias("before"), F.sum("after").alias("after"))


def double_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
