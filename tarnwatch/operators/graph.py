"""Connected components by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.session import cut, kept_table


def _neighbour_minimum(edges: DataFrame) -> DataFrame:
    """(u, v, m) with m the smallest id among u and all its neighbours.

    The minimum is a map-side combined aggregate and is joined back, so a node
    with very many neighbours is never held in one window partition.
    """
    smallest = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(smallest, "u")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node id; only nodes with edges appear.

    Large-star links every larger neighbour of a node to the node's minimum,
    small-star does the same for smaller ones; together they converge in a
    logarithmic number of rounds. Every round is written to the checkpoint folder.
    """
    work = edges.select(F.least(src, dst).alias("b"), F.greatest(src, dst).alias("a")).distinct()
    work = cut(work.select(F.col("a").alias("u"), F.col("b").alias("v")))
    nodes = work.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    fingerprint = None
    for _ in range(max_rounds):
        both = work.where("u <> v").unionByName(work.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _neighbour_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # every edge now points from a larger to a smaller node
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = _neighbour_minimum(down)
        small = (low.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v")))).where("u <> v").distinct()
        work = cut(small)
        now = tuple(work.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == fingerprint:
            break
        fingerprint = now
    else:
        raise RuntimeError("connected components did not converge")
    stars = work.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.join(stars, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def smallest_reached(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 with links u - v, the smallest node that each one reaches."""
    low = np.arange(n)
    while (low[u] != low[v]).any():
        least = np.minimum(low[u], low[v])
        np.minimum.at(low, low[u], least)
        np.minimum.at(low, low[v], least)
        while (low[low] != low).any():
            low = low[low]
    return low


def _batch_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(0)
        ids, owner = lists.flatten(), np.repeat(np.arange(len(lists)), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(int))
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        nodes, at = np.unique(ids.fill_null(0).to_numpy()[known], return_inverse=True)
        place = np.cumsum(known) - 1
        linked = np.flatnonzero((owner[1:] == owner[:-1]) & known[1:] & known[:-1])
        links = np.unique(at[place[linked]] * len(nodes) + at[place[linked + 1]])
        low = smallest_reached(len(nodes), links // max(len(nodes), 1), links % max(len(nodes), 1))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[low], pa.int64())], names=["node", "part"])


def chained_components(lists: DataFrame, column: str) -> DataFrame:
    """(node, component) of the ids in an array column, where neighbours in an array are linked.

    Every Arrow batch is reduced to (node, smallest id of the node's part of the batch) where it is made, so links that
    overlapping arrays repeat go no further. Only parts that share a node are linked, and the search for components
    runs over parts, not over ids. A null in an array links nothing.
    """
    parts = lists.select(column).mapInArrow(_batch_parts, "node long, part long")
    parts = lists.sparkSession.read.schema(parts.schema).parquet(kept_table(parts, "parts"))
    least = parts.groupBy("node").agg(F.min("part").alias("least"))
    links = parts.join(least, "node").select("part", "least").distinct()
    found = connected_components(links, "part", "least").withColumnRenamed("node", "least")
    return least.join(found, "least").select("node", "component")
