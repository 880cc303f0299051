"""N-gram Jaccard join over a token-group matrix (operator 9).

Documents are sets of word shingles and link when ``100 * intersection >= percent * union``. The result is
exact: one row for each document with its component of links.

1. Equal sets are one class. A class's prefix are its first tokens (shingle hashes), as many as a partner
   cannot all miss; tokens of a count-sketch bucket that is much fuller than others come last in the order, so
   prefixes hold rare tokens and passages shared by many documents form no long lists.
2. Partition into groups: each class is checked against one leader, of the classes that share most of its prefix
   tokens the most central one (with the largest share of common tokens). Then classes that share a token with many
   others of other leaders ask sixteen drawn ones. Verified links make the groups (connected components). A cluster
   of near copies becomes one group by a number of checks that is linear in its size, also where its members link
   to few of the others.
3. The matrix holds each group's union of prefix tokens, for tokens of two groups or more. A class's overlap
   with any member of a group is bounded from the tokens that the group lacks; only groups whose bound reaches
   what a link needs are opened, their members bounded alike. Two classes meet only at places early enough in both for
   a link of their sizes, so near copies that link to none meet by few tokens. Pairs that are left are bounded by parity bitmaps
   (two bits for each token; where two bitmaps differ, the sets do), and the rest verified on whole sets.
4. Components of all verified links are the result.

Inside a group no pairs are formed, and across groups only those that pass the bounds. Whole sets travel for
classes with something to verify only. What the driver holds and sends has a bounded size: a bit for each counter
of the sketch (one for eight shingles, 2**MOST_BUCKETS at most, 16 MB) and a bitmap (``BITS`` bits); both only save
work and lose nothing when they fill up.

Words are what white space (space, tab to carriage return) separates, A-Z lower-cased. A text with fewer words
than ``width`` has its whole sequence as its one shingle. Null and empty texts have no set and link with
nothing. Rows that share an id are documents of their own; a null id is no component's name unless nothing else
is. Equal texts share a component. Long texts are read whole; tables without rows give none; other columns
are ignored. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.llm.common import slices, table
from tarnwatch.operators.graph import connected_components

WIDTH, PERCENT = 4, 85
#: Powers of two of the sketch's counters, which count to FULL in a task, and counters in a block of them.
LEAST_BUCKETS, MOST_BUCKETS, FULL, CHUNK = 20, 27, 255, 1 << 16
BITS = 1 << 25
#: Share of its prefix that a class must share with a leader to be checked against it in step 2.
LEADER_SHARE = 0.4
#: The second turn of leaders is for tokens in the prefixes of HOT classes or more; LEADERS are asked.
HOT, LEADERS = 24, 16


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(width, len(w))
    rolled = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + w[i:len(w) - n + 1 + i]
        rolled ^= rolled >> np.uint64(29)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(rolled ^ (rolled >> np.uint64(32)))


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def parities(h: np.ndarray) -> bytes:
    """A bitmap of two to four bits for each token: whether an odd number of tokens fall on a bit."""
    size = 1 << max(6, (2 * len(h) - 1).bit_length())
    odd = np.bincount(((h >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def most_overlap(nx: int, x: bytes, ny: int, y: bytes) -> int:
    """A bound on two sets' overlap: where their bitmaps, folded to one size, differ, so do the sets."""
    x, y = np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return (nx + ny - int(np.unpackbits(x ^ y).sum())) // 2


def buckets_for(docs: DataFrame) -> int:
    """Counters of the sketch: about one for eight shingles (six characters make one), between two bounds."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return 1 << min(MOST_BUCKETS, max(LEAST_BUCKETS, (chars // 48).bit_length() - 1))


def common_buckets(docs: DataFrame, width: int) -> np.ndarray:
    """One bit for each sketch bucket: whether it is much fuller than the others; counted over all texts."""
    buckets = buckets_for(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.uint8)
        for batch in slices(batches):
            found = [shingles(t, width) for t in batch.column(0).to_pylist()]
            at, times = np.unique((np.concatenate(found) & np.uint64(buckets - 1)).astype(np.int64), return_counts=True)
            total[at] = np.minimum(total[at] + times, FULL)
        for lo in range(0, buckets, CHUNK):
            part = total[lo:lo + CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([lo // CHUNK], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(data), np.uint8)
                if chunk in total:
                    total[chunk] += part
                else:
                    total[chunk] = part.astype(np.uint32)
        for chunk, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([int(counts.sum())], pa.int64()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())],
                                             names=["chunk", "n", "counts"])

    parts = docs.select("text").mapInArrow(count, "chunk int, counts binary").repartition(buckets // CHUNK, "chunk")
    merged = table(parts.mapInArrow(add, "chunk int, n long, counts binary"), "jac_sketch")
    mean = (merged.agg(F.sum("n")).first()[0] or 0) / buckets
    most = mean + 3 * mean ** 0.5 + 4

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(np.frombuffer(zlib.decompress(d), np.uint32) > most, bitorder="little").tobytes() for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["chunk", "bits"])

    out = np.zeros(buckets // 8, dtype=np.uint8)
    for row in merged.select("chunk", "counts").mapInArrow(judge, "chunk int, bits binary").collect():  # a bit for each bucket
        out[row.chunk * CHUNK // 8:(row.chunk + 1) * CHUNK // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def prefixes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n, cls, prefix, bits and the share of common tokens (null where the task has met the class before), for each document."""
    bits = docs.sparkSession.sparkContext.broadcast(common_buckets(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, met = bits.value, set()
        last = np.uint64(8 * len(common) - 1)
        for batch in slices(batches):
            ns, classes, lists, maps, shares = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                h = shingles(text, width)
                ns.append(len(h))
                if not len(h):
                    classes.append(None)
                    lists.append(None)
                    maps.append(None)
                    shares.append(None)
                    continue
                cls = xxhash.xxh3_64_intdigest(h.tobytes()) >> 1
                classes.append(cls)
                if cls in met:
                    lists.append(None)
                    maps.append(None)
                    shares.append(None)
                    continue
                met.add(cls)
                late = is_set(common, (h & last).astype(np.int64))
                keys = np.concatenate([h[~late] >> np.uint64(2), (h[late] >> np.uint64(2)) | np.uint64(1 << 62)]).astype(np.int64)
                lists.append(keys[:len(h) - needed(len(h), percent) + 1])
                maps.append(parities(h))
                shares.append(float(late.mean()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(classes, pa.int64()), pa.array(lists, pa.list_(pa.int64())), pa.array(maps, pa.binary()), pa.array(shares, pa.float64())],
                                             names=["doc_id", "n", "cls", "prefix", "bits", "share"])

    found = table(docs.mapInArrow(run, "doc_id long, n long, cls long, prefix array<long>, bits binary, share double"), "jac_prefixes")
    bits.destroy()
    return found


def bitmap(df: DataFrame, key: str) -> np.ndarray:
    """BITS bits: the hashes of a column's values; built by map-side combined aggregates."""
    at = F.pmod(F.xxhash64(key), F.lit(BITS)) + 1
    rows = df.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p")).groupBy("b").agg(
        F.bitmap_construct_agg("p").alias("bits"))
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for row in rows.collect():  # at most BITS / 32768 rows of 4 KiB
        out[(row.b - 1) * 4096:row.b * 4096] = np.frombuffer(row.bits, dtype=np.uint8)
    return out


def is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7)) & 1 == 1


def token_rows(held: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """key, cls, n, pos (from 1), last (the prefix's last key), share, without keys that ``only`` rules out."""
    rows = held.where("prefix is not null").select("cls", "n", "share", F.col("prefix")[F.size("prefix") - 1].alias("last"), F.posexplode("prefix").alias("pos", "key"))
    rows = rows.select("key", "cls", "n", (F.col("pos") + 1).alias("pos"), "last", "share")
    if only is None:
        return rows
    bits = held.sparkSession.sparkContext.broadcast(only)  # BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = is_set(bits.value, batch.column(6).to_numpy())
            yield batch.filter(pa.array(keep)).select(range(6))

    hashed = rows.withColumn("at", F.pmod(F.xxhash64("key"), F.lit(BITS)))
    return hashed.mapInArrow(run, rows.schema)


def whole_sets(docs: DataFrame, held: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """cls, tokens (binary) of the classes in ``pairs``, made again from one document of each."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    first = held.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id")).join(asked, "cls")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(first, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in slices(batches):
            batch = batch.filter(pa.array(is_set(bits.value, batch.column(0).to_numpy())))
            classes, data = [], []
            for text in batch.column(1).to_pylist():
                h = shingles(text, width)
                cls = xxhash.xxh3_64_intdigest(h.tobytes()) >> 1
                if len(h) and cls not in met:
                    met.add(cls)
                    classes.append(cls)
                    data.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(data, pa.binary())], names=["cls", "tokens"])

    at = F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).alias("at")
    found = docs.select(at, "text").mapInArrow(run, "cls long, tokens binary")
    sets = table(found.join(asked, "cls", "left_semi").dropDuplicates(["cls"]), "jac_sets")
    bits.destroy()
    return sets


def verified(docs: DataFrame, held: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    maps = held.where("bits is not null").select("cls", "n", "bits").dropDuplicates(["cls"])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
            keep = [(100 + percent) * most_overlap(nx, x, ny, y) >= percent * (nx + ny) for nx, x, ny, y in rows]
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    named = lambda side, n, bits: maps.select(F.col("cls").alias(side), F.col("n").alias(n), F.col("bits").alias(bits))
    bounded = pairs.join(named("a", "nx", "x"), "a").join(named("b", "ny", "y"), "b").select("a", "b", "nx", "x", "ny", "y")
    pairs = table(bounded.mapInArrow(bound, "a long, b long"), "jac_pairs")
    sets = whole_sets(docs, held, pairs, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    joined = pairs.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("x")), "a").join(
        sets.select(F.col("cls").alias("b"), F.col("tokens").alias("y")), "b")
    return table(joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "jac_links")


def leader_pairs(tokens: DataFrame, percent: int) -> DataFrame:
    """(a, b): each class and the leader that most of its prefix tokens name, if enough do."""
    votes = tokens.where("cls <> leader").groupBy("cls", "leader").agg(F.count("*").alias("hits"), F.max("n").alias("n"))
    best = votes.groupBy("cls").agg(F.max(F.struct("hits", -F.col("leader"))).alias("best"), F.max("n").alias("n"))
    size = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    return best.where(F.col("best.hits") >= LEADER_SHARE * size).select(F.col("cls").alias("a"), (-F.col("best.col2")).alias("b"))


def further_pairs(tokens: DataFrame) -> DataFrame:
    """(a, b): classes that share a prefix token with many others, and ``LEADERS`` of these that are in other groups.

    Leaders are drawn by hashes, so that a whole family meets the same ones: members that link to a tenth of the
    others only soon form one group.
    """
    held = tokens.groupBy("key").agg(F.count("*").alias("held"), F.min("group").alias("g0"), F.max("group").alias("g1"))
    rows = table(tokens.join(held.where((F.col("held") >= HOT) & (F.col("g0") != F.col("g1"))), "key").select("key", "cls", "group", "held"), "jac_hot")
    if rows.isEmpty():
        return rows.select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    leader = F.struct("cls", "group")
    drawn = [F.min_by(leader, F.xxhash64("cls", F.lit(i))) for i in range(LEADERS)]
    named = rows.groupBy("key").agg(F.array(*drawn).alias("leaders"))
    best = rows.join(named, "key").groupBy("cls", "group").agg(F.max_by("leaders", F.struct("held", "key")).alias("leaders"))
    pairs = best.select("cls", "group", F.explode(F.array_distinct("leaders")).alias("leader")).where("leader.group <> group")
    return pairs.select(F.least("cls", "leader.cls").alias("a"), F.greatest("cls", "leader.cls").alias("b")).distinct()


def cross_pairs(tokens: DataFrame, percent: int) -> DataFrame:
    """(a, b) of classes in different groups that the bounds leave; ``tokens`` has a column group.

    A token of a's prefix that is no later than b's last prefix token and not in b's prefix is not in b. So
    with ``hits`` shared tokens and ``far`` the place in a of the last of them, b lacks far - hits tokens of a.

    What comes before the first shared token is not shared, so in sets that link it has an early place in both: no later
    than the set's size less what this pair of sizes needs, plus one. Other meetings of two classes are not joined, nor
    those with a group of one class; what stays are the first meetings of a pair, so ``hits`` still counts all up to ``far``.
    """
    spans = tokens.groupBy("key").agg(F.min("group").alias("g0"), F.max("group").alias("g1")).where("g0 <> g1").select("key")
    rows = table(tokens.join(spans, "key"), "jac_open")
    groups = rows.groupBy(F.col("group").alias("g")).agg(F.min("n").alias("g_least"), F.max("n").alias("g_most"), F.min("last").alias("g_last"), (F.min("cls") == F.max("cls")).alias("g_one"))
    matrix = rows.groupBy("key", F.col("group").alias("g")).agg(F.min("pos").alias("g_pos")).join(groups, "g")
    t = percent / 100
    short = F.greatest(F.col("g_least"), F.ceil(F.lit(percent) * F.col("n") / 100))
    need = F.ceil(F.lit(percent) * (F.col("n") + short) / (100 + percent) - 1e-9)
    known = F.col("key") <= F.col("g_last")
    early = ~F.col("g_one") | (F.col("pos") <= F.col("n") - need + 1) & (F.col("g_pos") <= F.col("g_most") - need + 1)
    asks = (rows.join(matrix, "key")
            .where((F.col("g") < F.col("group")) & early & (F.col("g_most") >= t * F.col("n") - 1e-9) & (t * F.col("g_least") <= F.col("n") + 1e-9))
            .groupBy("cls", "g").agg(F.max("n").alias("n"), F.max("g_least").alias("g_least"), F.count(F.when(known, 1)).alias("hits"),
                                     F.coalesce(F.max(F.when(known, F.col("pos"))), F.lit(0)).alias("far"))
            .where(F.col("n") - (F.col("far") - F.col("hits")) >= need))
    q = rows.join(asks.select("cls", "g"), "cls").select("key", "g", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    d = rows.select("key", F.col("group").alias("g"), F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    at_most = F.least("pa", "pb") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))  # shared up to this token, and after it
    need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / (100 + percent) - 1e-9)
    met = q.join(d, ["key", "g"]).where((F.col("na") >= t * F.col("nb") - 1e-9) & (F.col("nb") >= t * F.col("na") - 1e-9) & (at_most >= need)
                                        & (F.col("pa") <= F.col("na") - need + 1) & (F.col("pb") <= F.col("nb") - need + 1))
    pairs = met.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.count("*").alias("hits"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    most = F.least(F.col("na") - (F.col("pa") - F.col("hits")), F.col("nb") - (F.col("pb") - F.col("hits")),
                   F.col("hits") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")))
    return pairs.where(most >= need).select("a", "b")


def components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) for every row."""
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    held = prefixes(docs, width, percent)
    # the class with the largest share of common tokens, as one number: variants of a text meet the text they were made from
    central = F.shiftleft((F.col("share") * 1000).cast("long"), 53).bitwiseOR(F.shiftright("cls", 10))
    shared = token_rows(held).groupBy("key").agg(F.max_by("cls", central).alias("leader"), F.min("cls").alias("c0"), F.max("cls").alias("c1"))
    shared = shared.where("c0 <> c1").select("key", "leader")
    shared = table(shared, "jac_shared")
    rows = token_rows(held, bitmap(shared, "key")).dropDuplicates(["key", "cls"])
    tokens = table(rows.join(shared, "key"), "jac_tokens")  # so the bitmap's broadcast is read once
    links = verified(docs, held, leader_pairs(tokens, percent), width, percent)

    star = links.groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("group"))  # a part of each group, without a search for all of it
    stars = tokens.join(star, "cls", "left").withColumn("group", F.coalesce("group", "cls"))
    links = table(links.unionByName(verified(docs, held, further_pairs(stars), width, percent)), "jac_links")
    group = table(connected_components(links, "a", "b"), "jac_groups").withColumnsRenamed({"node": "cls", "component": "group"})
    named = tokens.drop("leader").join(group, "cls", "left").withColumn("group", F.coalesce("group", "cls"))
    more = verified(docs, held, cross_pairs(named, percent), width, percent)
    final = connected_components(links.unionByName(more), "a", "b").withColumnsRenamed({"node": "cls", "component": "root"})
    rooted = table(held.select("doc_id", "n", "cls").join(final, "cls", "left").withColumn("root", F.coalesce("root", "cls")), "jac_rooted")
    least = rooted.where("root is not null").groupBy(F.col("root").alias("r")).agg(F.min("doc_id").alias("least"))
    return rooted.join(least, F.col("root") == F.col("r"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
