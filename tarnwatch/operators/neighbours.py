"""Exact nearest neighbours inside classes, over tiles of equal size.

The distinct points of a class are sites. They are cut into slabs of equal size along one axis and each slab into
tiles along another, by ranks and not by values, so dense places get small tiles. A site asks its own tile first. The
distance of its k-th site there bounds what it still has to see: the tiles that the ball of this radius touches, and no
others. So the result is certified, whatever the density, with two looks at the data.

A tile has about ``TILE`` sites, more where there would be over ``MAX_TILES`` tiles; the table of tile borders is the
one thing that every task gets, and ``MAX_TILES`` bounds it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.operators.scan import map_sorted_groups, range_ranks
from tarnwatch.session import cut

TILE, MAX_TILES = 400, 50_000
#: Distances held at a time.
BLOCK = 1 << 21


def tiled(sites: DataFrame, label: str, axes: list[str], tile: int) -> DataFrame:
    """``sites`` with _slab and _tile; sites of a class are dealt by ranks along the first and second axis."""
    sizes = sites.groupBy(label).agg(F.count("*").alias("_n")).withColumn("_cuts", F.ceil(F.sqrt(F.ceil(F.col("_n") / tile))))
    at = range_ranks(sites, [label], [axes[0], "_first"], "_at").join(sizes, label)
    slabs = at.withColumn("_slab", F.floor((F.col("_at") - 1) * F.col("_cuts") / F.col("_n")).cast("int"))
    within = Window.partitionBy(label, "_slab")  # a slab is the root of the tiles of its class in size
    place = F.row_number().over(within.orderBy(axes[-1], "_first")) - 1
    return slabs.withColumn("_tile", F.floor(place * F.col("_cuts") / F.count("*").over(within)).cast("int")).drop("_n", "_cuts", "_at")


def nearest_sites(sites: DataFrame, label: str, columns: list[str], scales: dict[str, float], k: int, tile: int = TILE) -> DataFrame:
    """(label, _first, near): for sites with _make > 0 the sites of their class by (distance, _first), themselves included.

    ``sites`` has label, columns, _first (a number that names the site in its class), _weight and _make. ``near`` has
    the k + 1 nearest as structs (distance, first, weight, x), distances over columns divided by their scales.
    """
    spark = sites.sparkSession
    axes = [c for c in columns if scales[c] > 0][:2] or columns[:1]
    names = ["_first", "_weight", "_make", *columns]
    total = sites.count()
    placed = cut(tiled(sites.select(label, *names), label, axes, max(tile, math.ceil(total / MAX_TILES))))
    divide = np.array([scales[c] or 1.0 for c in columns])
    label_type = sites.schema[label].dataType.simpleString()
    found = f"`{label}` {label_type}, _q long, _make long, _bound double, _d double, _first long, _weight long, " + ", ".join(f"`_x{i}` double, `_q{i}` double" for i in range(len(columns)))
    xs, qs = [f"_x{i}" for i in range(len(columns))], [f"_q{i}" for i in range(len(columns))]

    def meet(asks: pd.DataFrame, rows: pd.DataFrame, bound: np.ndarray | None) -> pd.DataFrame:
        """Each ask with its k + 1 nearest rows and all that tie with the last of them, none beyond the bound."""
        a, x = asks[qs].to_numpy(float), rows[columns].to_numpy(float)
        at, to, far, edges = [], [], [], []
        step = max(1, BLOCK // max(1, len(x)))
        for lo in range(0, len(a), step):
            d = sum(((a[lo:lo + step, None, i] - x[None, :, i]) / divide[i]) ** 2 for i in range(len(columns)))
            edge = np.partition(d, k, axis=1)[:, k] if len(x) > k else np.full(len(d), np.inf)
            i, j = np.nonzero(d <= (edge if bound is None else np.minimum(edge, bound[lo:lo + step]))[:, None])
            at.append(i + lo)
            to.append(j)
            far.append(d[i, j])
            edges.append(edge)
        at, to = np.concatenate(at), np.concatenate(to)
        out = asks.iloc[at][[label, "_q", "_make", *qs]].reset_index(drop=True)
        out["_bound"] = np.concatenate(edges)[at]
        out["_d"] = np.concatenate(far)
        for name, values in zip(["_first", "_weight", *xs], [rows["_first"], rows["_weight"], *x.T], strict=True):
            out[name] = np.asarray(values)[to]
        return out

    def by_group(rows: pd.DataFrame, group: np.ndarray, fn) -> pd.DataFrame:
        edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
        parts = [p for p in (fn(rows.iloc[lo:hi]) for lo, hi in zip(edges[:-1], edges[1:], strict=True)) if p is not None]
        return pd.concat(parts) if parts else pd.DataFrame({n: [] for n in (label, "_q", "_make", "_bound", "_d", "_first", "_weight", *xs, *qs)})

    def asking(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.rename(columns={"_first": "_q", **dict(zip(columns, qs, strict=True))})

    def at_home(rows: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        return by_group(rows, group, lambda g: meet(asking(g[g["_make"] > 0]), g, None) if (g["_make"] > 0).any() else None)

    def as_guests(rows: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        def one(g: pd.DataFrame):
            guests = g[g["_guest"]]
            return meet(asking(guests), g[~g["_guest"]], guests["_bound"].to_numpy()) if len(guests) else None
        return by_group(rows, group, one)

    keys = [label, "_slab", "_tile"]
    doubles = [F.col(f"`{c}`").cast("double").alias(c) for c in columns]
    flat = placed.select(*keys, "_first", "_weight", "_make", *doubles)
    home = cut(map_sorted_groups(flat, keys, ["_first"], at_home, found, spread=True))

    first, last = (flat[c] / F.lit(scales[c] or 1.0) for c in (axes[0], axes[-1]))
    borders = flat.groupBy(*keys).agg(F.min(first).alias("a0"), F.max(first).alias("a1"), F.min(last).alias("b0"), F.max(last).alias("b1"))
    # MAX_TILES rows and, for tiles that are not full, three more for each class at most
    shared = spark.sparkContext.broadcast(_by_class(borders.toPandas(), label))
    ax = [columns.index(axes[0]), columns.index(axes[-1])]

    def route(batches):
        for batch in batches:
            parts = [_touched(g, shared.value[value], [f"_q{i}" for i in ax], divide[ax]) for value, g in batch.groupby(label, sort=False)]
            if parts:
                yield pd.concat(parts)

    asks = home.where("_q = _first").select(label, "_q", "_make", "_bound", *qs).join(
        flat.select(label, F.col("_first").alias("_q"), F.col("_slab").alias("_s"), F.col("_tile").alias("_t")), [label, "_q"])
    guests = asks.mapInPandas(route, asks.select(label, F.col("_s").alias("_slab"), F.col("_t").alias("_tile"), "_q", "_make", "_bound", *qs).schema)
    both = flat.select(*keys, "_first", "_weight", "_make", F.lit(0.0).alias("_bound"), F.lit(False).alias("_guest"), *columns).unionByName(
        guests.select(*keys, F.col("_q").alias("_first"), F.lit(0).cast("long").alias("_weight"), "_make", "_bound", F.lit(True).alias("_guest"),
                      *[F.col(q).alias(c) for q, c in zip(qs, columns, strict=True)]))
    away = map_sorted_groups(both, keys, ["_guest", "_first"], as_guests, found, spread=True)
    near = F.struct(F.col("_d").alias("distance"), F.col("_first").alias("first"), F.col("_weight").alias("weight"), F.array(*xs).alias("x"))
    return home.unionByName(away).groupBy(label, F.col("_q").alias("_first")).agg(
        F.max("_make").alias("_make"), F.slice(F.array_sort(F.collect_list(near)), 1, k + 1).alias("near"))


def _by_class(borders: pd.DataFrame, label: str) -> dict:
    """Per class: slab borders along the first axis and, for each slab, its tiles in order."""
    out = {}
    for value, g in borders.sort_values(["_slab", "_tile"]).groupby(label, sort=False):
        slabs = g.groupby("_slab").agg(a0=("a0", "min"), a1=("a1", "max"))
        tiles = {s: t[["_tile", "a0", "a1", "b0", "b1"]].to_numpy(float) for s, t in g.groupby("_slab")}
        out[value] = (slabs.index.to_numpy(), slabs["a0"].to_numpy(), slabs["a1"].to_numpy(), tiles)
    return out


def _touched(asks: pd.DataFrame, known, names: list[str], divide: np.ndarray) -> pd.DataFrame:
    """One row for each ask and tile, other than its own, that its ball touches."""
    slabs, a0, a1, tiles = known
    a, b = (asks[n].to_numpy(float) / v for n, v in zip(names, divide, strict=True))
    bound = asks["_bound"].to_numpy()
    reach = np.sqrt(bound) * (1 + 1e-12)  # rounding must not hide a tile
    lo, hi = np.searchsorted(a1, a - reach, "left"), np.searchsorted(a0, a + reach, "right")
    rows, where, tile = [], [], []
    for i, s in enumerate(slabs):
        at = np.flatnonzero((lo <= i) & (i < hi))
        if not len(at):
            continue
        t = tiles[s]
        from_, to = np.searchsorted(t[:, 4], b[at] - reach[at], "left"), np.searchsorted(t[:, 3], b[at] + reach[at], "right")
        times = np.maximum(to - from_, 0)
        who = np.repeat(at, times)
        which = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(from_, times)
        gap = np.maximum(0, np.maximum(t[which, 1] - a[who], a[who] - t[which, 2])) ** 2
        if names[0] != names[1]:
            gap = gap + np.maximum(0, np.maximum(t[which, 3] - b[who], b[who] - t[which, 4])) ** 2
        near = gap <= bound[who] * (1 + 1e-9)
        rows.append(who[near])
        where.append(np.full(near.sum(), s))
        tile.append(t[which[near], 0].astype(np.int64))
    rows, where, tile = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, where, tile))
    away = (where != asks["_s"].to_numpy()[rows]) | (tile != asks["_t"].to_numpy()[rows])
    out = asks.iloc[rows[away]].copy()
    out["_slab"], out["_tile"] = where[away].astype(np.int32), tile[away].astype(np.int32)
    return out[[asks.columns[0], "_slab", "_tile", "_q", "_make", "_bound", *[c for c in asks.columns if c.startswith("_q") and c != "_q"]]]
