"""Approximate nearest neighbours with robust-pruned directed graphs (operator 2).

Distinct vectors are dealt by hash to shards of about ``SHARD`` vectors, so shards are even whatever the data.
Each shard gets a directed graph: starting from random edges, a greedy beam search for every vector proposes
the vectors that it met; these are pruned to diverse neighbours (nearest first; a candidate goes when it is
closer to a chosen neighbour, times ``ALPHA``, than to the vector itself), and edges back are added and pruned
alike. A query beam-searches the graph of every shard; the shards' finds are merged by the exact cosine, in
double precision on the original vectors. Every vector is in the index.

Equal vectors are one node, since copies of one vector would use up each other's edges; of each vector the
``k + 1`` smallest ids can appear in a result and are kept by the side. Queries with equal vectors are
searched once. Ties go to the smaller id; a query never finds its own id, but does find copies under others.

Vectors that are null, empty, zero or hold null or non-finite components take no part, neither as queries nor
as candidates; so do null ids. Repeated ids with equal vectors count once. All vectors must have one length.
With fewer candidates than ``k`` all are returned; tables without rows give none. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.llm.common import table

SHARD, DEGREE, SLACK, EXPAND, ALPHA = 8_192, 24, 12, 4, 1.2
#: Beam widths while building and while searching.
BUILD_BEAM, SEARCH_BEAM = 64, 128
BATCH = 256


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # first, so that squares neither overflow nor vanish
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def distinct_in_rows(ids: np.ndarray) -> np.ndarray:
    """``ids`` with later repeats in a row set to -1 (rows come back sorted)."""
    ids = np.sort(ids, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    return ids


class Graph:
    """One shard: unit vectors and up to DEGREE + SLACK neighbours for each (-1: none)."""

    def __init__(self, x: np.ndarray, links: np.ndarray | None = None):
        self.x, n = x, len(x)
        middle = x.mean(0)
        self.start = np.unique([int(np.argmax(x @ middle)), 0, n // 3, 2 * n // 3])
        if links is None:
            rng = np.random.default_rng(n)
            links = np.full((n, DEGREE + SLACK), -1, dtype=np.int32)
            if n > 1:
                some = min(DEGREE // 2, n - 1)
                links[:, :some] = (np.arange(n)[:, None] + rng.integers(1, n, (n, some))) % n
                links[:] = distinct_in_rows(links)
            self.links = links
            self.build(rng.permutation(n))
        else:
            self.links = links

    def search(self, q: np.ndarray, width: int = SEARCH_BEAM, met: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the beam for each row of ``q``, best first; ``met`` collects the expanded ids."""
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), len(self.x)), dtype=bool)
        ids = np.full((len(q), width), -1, dtype=np.int32)
        near = np.full((len(q), width), -np.inf, dtype=np.float32)
        done = np.ones((len(q), width), dtype=bool)
        k = min(width, len(self.start))
        ids[:, :k], done[:, :k], seen[:, self.start] = self.start[:k], False, True
        near[:, :k] = q @ self.x[self.start[:k]].T
        while not done.all():
            pick = np.argsort(np.where(done, np.inf, -near), axis=1, kind="stable")[:, :EXPAND]
            from_ids = np.where(done[rows, pick], -1, ids[rows, pick])
            done[rows, pick] = True
            if met is not None:
                met.append(from_ids)
            new = self.links[from_ids]
            new[from_ids < 0] = -1
            new = distinct_in_rows(new.reshape(len(q), -1))
            new[seen[rows, new]] = -1
            ok = new >= 0
            seen[np.broadcast_to(rows, new.shape)[ok], new[ok]] = True
            sim = np.full(new.shape, -np.inf, dtype=np.float32)
            at = np.nonzero(ok)
            sim[at] = np.einsum("id,id->i", q[at[0]], self.x[new[at]])
            all_near = np.concatenate([near, sim], axis=1)
            best = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
            near = all_near[rows, best]
            ids = np.concatenate([ids, new], axis=1)[rows, best]
            done = np.concatenate([done, ~ok], axis=1)[rows, best] | (ids < 0)
        order = np.argsort(-near, axis=1, kind="stable")
        return ids[rows, order], near[rows, order]

    def prune(self, of: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Up to DEGREE diverse neighbours for each of ``of`` from the candidates in its row of ``found``."""
        found = distinct_in_rows(np.where(found == of[:, None], -1, found))
        rows = np.arange(len(of))[:, None]
        there = self.x[found]
        far = np.where(found < 0, np.inf, 2 - 2 * np.einsum("bd,bcd->bc", self.x[of], there))
        order = np.argsort(far, axis=1, kind="stable")
        found, far, there = found[rows, order], far[rows, order], there[rows, order]
        between = 2 - 2 * np.matmul(there, there.transpose(0, 2, 1))
        alive, out, row = found >= 0, np.full((len(of), DEGREE), -1, dtype=np.int32), np.arange(len(of))
        for i in range(DEGREE):
            first = alive.argmax(1)
            some = alive[row, first]
            if not some.any():
                break
            out[:, i] = np.where(some, found[row, first], -1)
            alive &= ~((ALPHA * between[row, first] <= far) & some[:, None])
            alive[row, first] = False
        return out

    def build(self, order: np.ndarray) -> None:
        for at in range(0, len(order), BATCH):
            of = order[at:at + BATCH]
            met: list[np.ndarray] = []
            beam, _ = self.search(self.x[of], BUILD_BEAM, met)
            own = self.prune(of, np.concatenate([beam, *met, self.links[of]], axis=1))
            self.links[of] = -1
            self.links[of, :DEGREE] = own
            self.add_back(np.repeat(of, DEGREE)[own.ravel() >= 0], own.ravel()[own.ravel() >= 0])

    def add_back(self, new: np.ndarray, to: np.ndarray) -> None:
        """Edges ``to`` -> ``new``; nodes whose list is full are pruned again, with the new ones among the candidates."""
        order = np.lexsort((new, to))
        new, to = new[order].astype(np.int32), to[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        width = self.links.shape[1]
        for turn in range(0, int(count.max(initial=0)), width):  # some nodes get more at once than a list holds
            some = count > turn
            more = np.full((int(some.sum()), width), -1, dtype=np.int32)
            for j in range(width):
                has = count[some] > turn + j
                more[has, j] = new[first[some][has] + turn + j]
            of = nodes[some]
            lists = distinct_in_rows(np.concatenate([self.links[of], more], axis=1))
            lists = -np.sort(-lists, axis=1)
            fits = (lists >= 0).sum(1) <= width
            self.links[of[fits]] = lists[fits, :width]
            for part in np.array_split(np.nonzero(~fits)[0], max(1, int((~fits).sum()) // 512)):
                if len(part):
                    self.links[of[part]] = -1
                    self.links[of[part], :DEGREE] = self.prune(of[part], lists[part])


def usable(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>), h of the rows that take part."""
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    ok = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    return (rows.where("vec_id is not null and v is not null").where(ok & F.exists("v", lambda c: c != 0))
            .withColumn("v", F.transform("v", lambda c: c + F.lit(0.0))).withColumn("h", F.xxhash64("v")))


def members(df: DataFrame, k: int) -> DataFrame:
    """point, vec_id, v, h: of each distinct vector its k + 1 smallest ids; point is the smallest."""
    same = Window.partitionBy("h", "v").orderBy("vec_id")
    ranked = df.distinct().withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1)  # limited before the exchange
    return ranked.withColumn("point", F.min("vec_id").over(Window.partitionBy("h", "v"))).drop("nth")


INDEX = "shard int, point long, v array<double>, links array<int>"


def build_index(points: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """One row for each point: its shard, vector and neighbours (places among the shard's points by id)."""
    n = points.count()
    shards = max(1, math.ceil(n / shard_rows))
    dealt = points.select(F.pmod(F.xxhash64("h", F.lit("shard")), F.lit(shards)).cast("int").alias("shard"), "point", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows, _ in by_shard(batches):
            graph = Graph(unit(np.stack(rows.column("v").to_numpy(zero_copy_only=False))))
            links = [[int(i) for i in row[row >= 0]] for row in graph.links]
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.int32()), rows.column("point").combine_chunks(),
                                              rows.column("v").combine_chunks(), pa.array(links, pa.list_(pa.int32()))], names=["shard", "point", "v", "links"])

    return table(dealt.repartition(shards, "shard").sortWithinPartitions("shard", "point").mapInArrow(run, INDEX), "ann_index")


def by_shard(batches: Iterator[pa.RecordBatch], kind: str | None = None) -> Iterator[tuple[int, pa.Table, Iterator[pa.Table]]]:
    """Shards of sorted batches: (shard, rows), or with ``kind`` (shard, rows of kind 0, one batch of kind 1) again and again."""
    held: list[pa.Table] = []
    last, whole = None, None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        shard_of = rows.column("shard").to_numpy()
        cuts = [0, *(np.nonzero(shard_of[1:] != shard_of[:-1])[0] + 1), len(rows)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            part, shard = rows.slice(a, b - a), int(shard_of[a])
            if shard != last:
                if kind is None and held:
                    yield last, pa.concat_tables(held), None
                held, whole, last = [], None, shard
            if kind is None:
                held.append(part)
                continue
            asks = part.column(kind).to_numpy() == 1
            split = int(asks.argmax()) if asks.any() else len(part)
            if split:
                held.append(part.slice(0, split))
            if split < len(part) and held:
                whole = whole or pa.concat_tables(held)
                yield shard, whole, part.slice(split)
    if kind is None and held:
        yield last, pa.concat_tables(held), None


def search_index(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, point, score: the k best points that each shard finds for each query (qid, v).

    A shard's points come first in its partition and are held; the queries follow and are searched batch by
    batch, so memory does not grow with them.
    """
    shards = index.agg(F.max("shard")).first()[0]
    if shards is None:
        return index.sparkSession.createDataFrame([], "qid long, point long, score double")
    points = index.select("shard", F.lit(0).alias("kind"), F.col("point").alias("id"), "v", "links")
    asks = queries.select(F.explode(F.sequence(F.lit(0), F.lit(int(shards)))).alias("shard"), F.lit(1).alias("kind"),
                          F.col("qid").alias("id"), "v", F.lit(None).cast("array<int>").alias("links"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = graph = None
        for shard, rows, asked in by_shard(batches, "kind"):
            if shard != of:
                exact = np.stack(rows.column("v").to_numpy(zero_copy_only=False)).astype(np.float64)
                links = np.full((len(rows), DEGREE + SLACK), -1, dtype=np.int32)
                for i, found in enumerate(rows.column("links").to_pylist()):
                    links[i, :len(found)] = found
                names, norm, of = rows.column("id").to_numpy(), lengths(exact), shard
                graph = Graph(unit(exact), links)
            for at in range(0, len(asked), BATCH):
                part = asked.slice(at, BATCH)
                q = np.stack(part.column("v").to_numpy(zero_copy_only=False)).astype(np.float64)
                ids = graph.search(unit(q))[0][:, :k + 2]  # two more, as the order is by single precision here
                row, col = np.nonzero(ids >= 0)
                at_ = ids[row, col]
                score = np.einsum("id,id->i", q[row], exact[at_]) / (lengths(q)[row] * norm[at_])
                yield pa.RecordBatch.from_arrays([pa.array(part.column("id").to_numpy()[row]), pa.array(names[at_]), pa.array(score)],
                                                 names=["qid", "point", "score"])

    both = points.unionByName(asks).repartition(shards + 1, "shard").sortWithinPartitions("shard", "kind", "id")
    return both.mapInArrow(run, "qid long, point long, score double")


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("id,id->i", x, x))


def nearest(df: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score for the rows that the condition ``is_query`` on vec_id selects."""
    rows = usable(df, vec_id, vector)
    held = table(members(rows, k), "ann_members")
    index = build_index(held.where("point = vec_id").select("point", "v", "h"), shard_rows)
    asked = rows.where(is_query)
    alike = asked.groupBy("h", "v").agg(F.min("vec_id").alias("qid"))
    found = search_index(index, alike, k + 1)
    best = lambda by, n: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "vec_id")) <= n
    named = found.join(held.select("point", "vec_id"), "point").withColumn("top", best("qid", k + 1)).where("top").drop("top", "point")
    own = asked.select(F.col("vec_id").alias("query_id"), "h", "v").distinct().join(alike, ["h", "v"]).select("query_id", "qid")
    pairs = own.join(named, "qid").where("query_id <> vec_id")
    return (pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
