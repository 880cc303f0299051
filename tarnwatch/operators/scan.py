"""Ordered computations that survive hot keys.

A plain window over ``partitionBy(key)`` puts every row of a key into one task.
The helpers here cut a key's history into buckets (usually of time) first:

* ``running``  — running aggregates as *local part within the bucket* plus
  *carry from earlier buckets*. Only one summary row per (key, bucket) is ever
  brought together per key.
* ``range_ranks`` — the same for orders of any type: rows are range-partitioned
  on key and order, and the partition is the bucket.
* ``with_lookback`` — copies the rows a bucket needs from its predecessor, so
  bounded look-back windows can be evaluated per (key, bucket).
* ``map_sorted_groups`` — streams sorted (key, bucket) groups through a
  vectorised function, many groups per Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.session import cut

BUCKET = "_bucket"


def time_bucket(ts: str, width_seconds: int) -> Column:
    return F.floor(F.unix_seconds(F.col(ts)) / F.lit(int(width_seconds))).cast("long")


_COMBINE = {
    "count": lambda carry, local: F.coalesce(carry, F.lit(0)) + local,
    "sum": lambda carry, local: F.when(carry.isNull(), local)
    .when(local.isNull(), carry).otherwise(carry + local),
    "max": lambda carry, local: F.greatest(carry, local),
    "min": lambda carry, local: F.least(carry, local),
    "last": lambda carry, local: F.coalesce(local, carry),
    "first": lambda carry, local: F.coalesce(carry, local),
}


def _agg(kind: str, expr: Column, ordered_by: Column) -> Column:
    return {
        "count": lambda: F.count(expr),
        "sum": lambda: F.sum(expr),
        "max": lambda: F.max(expr),
        "min": lambda: F.min(expr),
        "last": lambda: F.max_by(expr, F.when(expr.isNotNull(), ordered_by)),
        "first": lambda: F.min_by(expr, F.when(expr.isNotNull(), ordered_by)),
    }[kind]()


def _window_agg(kind: str, expr: Column) -> Column:
    if kind == "last":
        return F.last(expr, ignorenulls=True)
    if kind == "first":
        return F.first(expr, ignorenulls=True)
    return _agg(kind, expr, None)


def running(df: DataFrame, keys: list[str], order: list[str], bucket: Column,
            specs: dict[str, tuple[str, Column]], peers: bool = False,
            exclusive: bool = False, group: int | None = None) -> DataFrame:
    """Running aggregates per key in ``order``, two-level.

    ``specs`` maps an output name to ``(kind, expr)``; kinds are count, sum, max,
    min, first and last. ``bucket`` must not decrease along ``order``. ``peers``
    includes rows tied with the current one; ``exclusive`` leaves the current
    row out. ``group`` is for keys with very many buckets: the summaries of so many
    neighbouring buckets form a group, and only one row per (key, group) meets its key.
    """
    base = df.withColumn(BUCKET, bucket)
    frame = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    if peers:
        frame = frame.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    else:
        frame = frame.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    local = base.select("*", *[_window_agg(kind, expr).over(frame).alias(f"_l_{name}")
                               for name, (kind, expr) in specs.items()])

    ordered_by = F.struct(*[F.col(c) for c in order])
    totals = base.groupBy(*keys, BUCKET).agg(
        *[_agg(kind, expr, ordered_by).alias(f"_t_{name}") for name, (kind, expr) in specs.items()])
    summed = {f"_c_{name}": ("sum" if kind == "count" else kind, F.col(f"_t_{name}"))
              for name, (kind, _) in specs.items()}
    if group:
        carry = running(totals.withColumnRenamed(BUCKET, "_at"), keys, ["_at"], F.floor(F.col("_at") / F.lit(group)),
                        summed, exclusive=True).withColumnRenamed("_at", BUCKET)
    else:
        earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(*keys, BUCKET, *[_window_agg(kind, expr).over(earlier).alias(name)
                                               for name, (kind, expr) in summed.items()])
    carry = carry.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(BUCKET).alias("_k_bucket"), *summed)

    on = F.col(BUCKET) == F.col("_k_bucket")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(carry, on)
    combined = [_COMBINE[kind](F.col(f"_c_{name}"), F.col(f"_l_{name}")).alias(name)
                for name, (kind, _) in specs.items()]
    return joined.select(*[F.col(c) for c in df.columns], *combined)


def range_ranks(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """1-based rank of every row of a key along ``order``, however many rows a key has.

    Partitions are cut at sampled values of key and order, so none holds a hot key whole; only the number of rows
    by (key, partition) is ever brought together per key. The cut is written to the checkpoint folder once, as a
    second sampling could cut elsewhere. Rows equal in key and order share a partition.
    """
    placed = cut(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    return running(placed, keys, ["_part", *order], F.col("_part"), {name: ("count", F.lit(1))}).drop("_part")


def with_lookback(df: DataFrame, ts: str, width_seconds: int, lookback_seconds: float) -> DataFrame:
    """Add ``_bucket`` and copy rows within ``lookback`` of the next bucket into it.

    ``_own`` marks the original row; copies only serve as context.
    """
    width = int(max(width_seconds, np.ceil(lookback_seconds)))
    micros = width * 1_000_000
    offset = F.pmod(F.unix_micros(F.col(ts)), F.lit(micros))
    reach = F.lit(int(np.ceil(lookback_seconds * 1_000_000)))
    copies = F.when(offset + reach >= F.lit(micros), F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0)))
    return (df.withColumn("_copy", F.explode(copies))
            .withColumn(BUCKET, F.floor(F.unix_micros(F.col(ts)) / F.lit(micros)).cast("long")
                        + F.col("_copy"))
            .withColumn("_own", F.col("_copy") == 0)
            .drop("_copy"))


def map_sorted_groups(df: DataFrame, keys: list[str], order: list[str],
                      fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame],
                      schema: str, spread: bool = False) -> DataFrame:
    """Run ``fn(rows, group)`` over whole groups, several groups per call.

    ``spread`` keeps all shuffle partitions (no coalescing of small ones), for
    functions that are expensive per row.

    Rows are hash-partitioned on ``keys`` and sorted by ``keys + order``. ``fn``
    receives complete groups as one frame plus an increasing group number per
    row, so it can work on flat arrays instead of once per group.
    """
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def number(frame: pd.DataFrame) -> np.ndarray:
            changed = np.zeros(len(frame), dtype=bool)
            for k in keys:
                values = frame[k].to_numpy()
                changed[1:] |= values[1:] != values[:-1]
            return np.cumsum(changed)

        pending: list[pd.DataFrame] = []

        def flush(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.reset_index(drop=True)
            return fn(frame, number(frame))

        for batch in batches:
            if not len(batch):
                continue
            group = number(batch)
            cutoff = int(np.searchsorted(group, group[-1], side="left"))
            tail_key = tuple(batch.iloc[-1][k] for k in keys)
            if pending:
                open_key = tuple(pending[-1].iloc[-1][k] for k in keys)
                if cutoff == 0 and open_key == tail_key:
                    pending.append(batch)
                    continue
            head = batch.iloc[:cutoff]
            ready = [*pending, head] if cutoff or pending else []
            pending = [batch.iloc[cutoff:]]
            if ready:
                out = flush(pd.concat(ready))
                if len(out):
                    yield out
        if pending:
            out = flush(pd.concat(pending))
            if len(out):
                yield out

    columns = [F.col(k) for k in keys]
    if spread:
        placed = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
    else:
        placed = df.repartition(*columns)
    return (placed
            .sortWithinPartitions(*keys, *order)
            .mapInPandas(run, schema=schema))
