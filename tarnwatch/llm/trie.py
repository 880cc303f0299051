"""Prefix trie of conversations (operator 13).

A node is a distinct sequence of the first d turns (role, text), from the root without turns on. A prefix is known
by 128 bits, the exclusive or of hashes of (position, role, text), so prefixes come from running aggregates in two
levels: turns are range-partitioned by (conversation, turn), and a conversation of any length is spread over as many
parts as it fills.

Most prefixes beyond the first turns belong to one conversation. A count-min sketch of all prefix digests (two rows
of counters that tell none, one and more; built by partition, merged by block) screens them: an estimate of one
proves a singleton, whose node is emitted where it is, without an exchange. Only prefixes that may be shared are
grouped exactly. The sketch has eight counters a prefix, up to ``MAX_CELLS`` a row; its set of counters above one is
broadcast and takes 2 * MAX_CELLS bits at most (32 MB). A fuller sketch proves less, so more is grouped exactly, and
the result is the same.

What a node needs of the trie is put on its conversations, so hot nodes (the root, a common first turn) are only
ever map-side combined sums: a conversation c is not the smallest member of its prefixes down to some depth s, and is
of all below. Then the nodes that c stands for are those deeper than s; c adds a child to the node at depth d if
s <= d < its length, a leaf to all its nodes if its last node is its own and childless, and to the saved tokens of a
node at depth d <= s the words of its turns d to s. No pass over levels is needed, and depth has no bound.

Conversations are ordered by turn, null first; equal turns by role and then by the SHA-256 of the text. Null roles
and texts are empty, equal rows are turns of their own. Rows without conv_id take no part. Texts are read whole. An
empty table has no node, not even a root. Other columns are not read. The list of members that end at a node is
hashed in order by one task a node, as SHA-256 asks; it gets the ids in written chunks (``CHUNK`` neighbouring ids
each, joined in parallel) and holds one at a time.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.llm.common import table
from tarnwatch.operators.scan import running

MAX_CELLS, BLOCK, SKETCH_ROWS = 1 << 27, 1 << 13, 2
CHUNK = 256
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, pos, key, words): turns numbered from 1; key is the digest of role and text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.encode(text, "utf-8"), 256)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"))
    order = ["turn", "role", "digest", "row"]  # the row number only lets equal rows go to several parts
    placed = table(turns.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "tr_turns")
    found = running(placed, ["conv_id"], ["part", *order], F.col("part"), {"pos": ("count", F.lit(1))})
    key = F.unhex(F.md5(F.to_binary(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("digest")), F.lit("utf-8"))))
    return found.select("conv_id", "part", "pos", key.alias("key"), "words")


def rebuilt(turns: DataFrame, family: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Turns after every conversation c has got the first crc32(c) % ``heads`` turns of c - c % ``family``, and (conv_id, length).

    The turns that are lent are ``heads`` - 1 at most, and a family has few members, so nothing here is hot but the
    turns of a long conversation, which meet one row of its own each.
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own"), F.min("part").alias("part"))
    own = own.withColumns({"h": (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int"), "base": F.col("conv_id") - F.col("conv_id") % family})
    lent = (turns.where((F.col("pos") < heads) & (F.col("conv_id") % family == 0)).groupBy(F.col("conv_id").alias("base"))
            .agg(F.array_sort(F.collect_list(F.struct("pos", "key", "words"))).alias("head")))
    convs = table(own.join(lent, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h"))).select(
        "conv_id", "part", "h", "head", (F.size("head") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("length")), "tr_convs")
    head = convs.select("conv_id", "part", "length", F.inline("head"))
    tail = turns.join(convs.select("conv_id", "h", "length", F.size("head").alias("m")), "conv_id").where("pos > h").select(
        "conv_id", "part", "length", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "key", "words")
    return head.unionByName(tail), convs.select("conv_id", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, length, depth, a, b, words, upto): digest (a, b) of every prefix, words of its last turn and of all its turns.

    Running exclusive or and running sum by conversation, in two levels: within a part, and over the parts before.
    """
    rows = turns.select("conv_id", "part", "length", "pos", "words", *[F.xxhash64(F.lit(i), "pos", "key").alias(n) for i, n in enumerate("ab")])
    within = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select("conv_id", "part", "length", "pos", "words", *[F.bit_xor(c).over(within).alias(c) for c in "ab"], F.sum("words").over(within).alias("upto"))
    totals = rows.groupBy("conv_id", "part").agg(*[F.bit_xor(c).alias(c) for c in "ab"], F.sum("words").alias("upto"))
    carry = totals.select("conv_id", "part", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"{c}0") for c in "ab"],
                          F.coalesce(F.sum("upto").over(before), F.lit(0)).alias("upto0"))
    found = local.join(carry, ["conv_id", "part"]).select(
        "conv_id", "length", F.col("pos").cast("long").alias("depth"), F.col("a").bitwiseXOR(F.col("a0")).alias("a"),
        F.col("b").bitwiseXOR(F.col("b0")).alias("b"), "words", (F.col("upto") + F.col("upto0")).alias("upto"))
    return found.sortWithinPartitions("conv_id", "depth")


def _cells(batch: pa.RecordBatch, cells: int) -> list[np.ndarray]:
    """Counters of each sketch row that the digests of a batch fall on."""
    return [(batch.column(c).to_numpy().view(np.uint64) % np.uint64(cells)).astype(np.int64) for c in "ab"]


def sketch(rows: DataFrame, cells: int) -> np.ndarray:
    """Bits of the counters above one, a row of bytes for each sketch row: at most 2 * MAX_CELLS bits in all."""
    blocks = cells // BLOCK

    def count(batches):
        one, more = np.zeros((2, SKETCH_ROWS, cells // 8), np.uint8)
        for batch in batches:
            for r, at in enumerate(_cells(batch, cells)):
                at, times = np.unique(at, return_counts=True)
                byte, bit = at >> 3, (1 << (at & 7)).astype(np.uint8)
                again = (times > 1) | (one[r, byte] & bit > 0)
                np.bitwise_or.at(more[r], byte[again], bit[again])
                np.bitwise_or.at(one[r], byte, bit)
        one, more = one.reshape(SKETCH_ROWS * blocks, -1), more.reshape(SKETCH_ROWS * blocks, -1)
        used = np.flatnonzero(one.any(axis=1))
        for at in np.array_split(used, len(used) // 1024 + 1):
            yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array([x[i].tobytes() for i in at], pa.binary()) for x in (one, more)]], names=["block", "one", "more"])

    def merge(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for block, *bits in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                one, more = (np.frombuffer(x, np.uint8) for x in bits)
                old = held.get(block)
                held[block] = [one, more] if old is None else [old[0] | one, old[1] | more | (old[0] & one)]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([m.tobytes() for _, m in held.values()], pa.binary())], names=["block", "more"])

    counted = rows.select("a", "b").mapInArrow(count, "block long, one binary, more binary")
    merged = counted.repartition("block").mapInArrow(merge, "block long, more binary")
    out = np.zeros((SKETCH_ROWS * blocks, BLOCK // 8), np.uint8)
    for r in merged.collect():  # bounded by the size of the sketch
        out[r["block"]] = np.frombuffer(r["more"], np.uint8)
    return out.reshape(SKETCH_ROWS, -1)


def screened(rows: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """``rows`` with ``alone`` (the sketch proves that one conversation has the prefix) and ``tail`` (so it is for the prefix before).

    ``tail`` is read from the row before, where the rows of a conversation lie together; at a border it stays false.
    """
    cells = min(max_cells, max(BLOCK, 1 << (8 * rows.count() - 1).bit_length()))
    shared = rows.sparkSession.sparkContext.broadcast(sketch(rows, cells))

    def judge(batches):
        bits, last = shared.value, (0, -1, False)
        for batch in batches:
            if not batch.num_rows:
                continue
            many = np.ones(batch.num_rows, bool)
            for r, at in enumerate(_cells(batch, cells)):
                many &= (bits[r, at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            before = [np.concatenate([[x], y]) for x, y in zip(last, (batch.column("conv_id").to_numpy(), batch.column("depth").to_numpy(), ~many), strict=True)]
            tail = ~many & before[2][:-1].astype(bool) & (before[0][:-1] == before[0][1:]) & (before[1][:-1] + 1 == before[1][1:])
            last = tuple(x[-1] for x in before)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(~many), pa.array(tail)], names=[*batch.schema.names, "alone", "tail"])

    return rows.mapInArrow(judge, f"{', '.join(f'`{n}` {t}' for n, t in rows.dtypes)}, alone boolean, tail boolean")


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) from (depth, a, b, conv_id) of conversations that end there."""
    keys = ["depth", "a", "b"]
    chunks = ends.groupBy(*keys, F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches):
        key, digest, out = None, None, []
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in (*keys, "ids")], strict=True)
            for now, parts in groupby(rows, key=lambda r: r[:3]):
                if now != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest, glue = now, hashlib.sha256(), b""
                for *_, ids in parts:
                    digest.update(glue + ids.encode())
                    glue = b","
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[*keys, "ends_sha256"])
                out = []
        if key is not None:
            out.append((*key, digest.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[*keys, "ends_sha256"])

    return chunks.repartition(*keys).sortWithinPartitions(*keys, "chunk").mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(conversations: DataFrame, family: int = 20, heads: int = 4, max_cells: int = MAX_CELLS) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, lengths = rebuilt(table(ordered_turns(conversations), "tr_ordered"), family, heads)
    seen = table(screened(table(prefixes(turns), "tr_prefixes"), max_cells), "tr_screened")
    keys, zero, one = ["depth", "a", "b"], F.lit(0).cast("long"), F.lit(1).cast("long")
    d, s, end = F.col("depth"), F.col("s"), F.col("depth") == F.col("length")

    roots = lengths.select("conv_id", "length", *[zero.alias(c) for c in (*keys, "words", "upto")])
    asked = table(seen.where("NOT alone").select(*roots.columns).unionByName(roots), "tr_asked")
    grouped = asked.groupBy(*keys).agg(F.min("conv_id").alias("smallest"), F.count("*").alias("n_convs"), F.sum(end.cast("long")).alias("n_ends"))

    # of each conversation: the depth s down to which a smaller one goes along, that one's node there, and whether it adds a leaf
    later = F.col("conv_id") != F.col("smallest")
    convs = asked.join(table(grouped, "tr_grouped"), keys).groupBy("conv_id").agg(
        F.max(F.when(later, F.struct("depth", "smallest", "upto"))).alias("last"), F.max(end).alias("end_asked"),
        F.max(F.when(end & ~later, F.col("n_convs") == F.col("n_ends"))).alias("leaf"))
    convs = table(convs.select("conv_id", F.coalesce("last.depth", F.lit(-1)).alias("s"), F.col("last.smallest").alias("above"),
                               F.coalesce("last.upto", zero).alias("upto_s"), F.coalesce("leaf", ~F.col("end_asked")).cast("long").alias("leaf")), "tr_summaries")
    parent = F.when(d == 0, None).when(d - 1 > s, F.col("conv_id")).otherwise(F.col("above"))

    shared = asked.join(convs, "conv_id").groupBy(*keys).agg(
        F.min("conv_id").alias("conv_id"), F.max(F.when(d > s, parent)).alias("parent_conv_id"), F.count("*").alias("n_convs"),
        F.sum(((d >= s) & (d < F.col("length"))).cast("long")).alias("n_children"), F.sum("leaf").alias("n_leaves"),
        F.sum(F.when(d > s, zero).otherwise(F.col("upto_s") - F.col("upto") + F.col("words"))).alias("saved_tokens"))
    ends = end_digests(asked.where(end).select(*keys, "conv_id"))
    shared = shared.join(ends, keys, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)))

    # proven singletons, where they are; only the first one of a conversation asks for its parent
    first = seen.where("alone AND NOT tail").join(convs.select("conv_id", "s", "above"), "conv_id").withColumn("parent_conv_id", parent)
    tails = seen.where("tail").withColumn("parent_conv_id", F.col("conv_id"))
    single = tails.select("conv_id", "depth", "length", "parent_conv_id").unionByName(first.select("conv_id", "depth", "length", "parent_conv_id")).withColumns(
        {"n_convs": one, "n_children": (d < F.col("length")).cast("long"), "n_leaves": one, "saved_tokens": zero,
         "ends_sha256": F.when(end, F.sha2(F.encode(F.col("conv_id").cast("string"), "utf-8"), 256)).otherwise(F.lit(EMPTY_SHA256))})
    return shared.select(*COLUMNS).unionByName(single.select(*COLUMNS))
