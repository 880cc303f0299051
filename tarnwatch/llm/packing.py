"""Best-fit decreasing packing of token sequences (operator 12).

Every text becomes ids of a tokenizer plus an end id; only documents longer than ``capacity`` are cut, into
pieces of ``capacity`` ids and a shorter last one. Pieces are packed by best-fit decreasing: the longest piece
first, each into the open sequence with the least room that still holds it. A segment tree over the remaining
capacities finds that room in logarithmic time. Pieces of one length differ in nothing that packing sees, and
neither do open sequences of one remaining capacity, so the plan is made for runs of both at once, from a count of
pieces by length (at most ``capacity`` rows, whatever the input). A row of the plan covers pieces of one length by
rank: sequences holding q of them each, from a first sequence on, at an offset. A run of sequences is met by fewer
than sqrt(2 * capacity) lengths, and each length adds three runs at most, so the plan has a proven bound of
3 * capacity * sqrt(2 * capacity) rows (about 1.1 million of 40 bytes for 4 096; tens of thousands in practice).

Ranks come from two-level counts: rows of a length are dealt over about as many buckets as the root of their number,
so copies that hold a third of all rows spread over many tasks. Tokenizing reads each text once and moves only
numbers; pieces are written to the shared folder before they are ranked, so a lost executor changes no rank.

Null texts are empty and hold the end id only. Rows with a null or a repeated id are packed like any other; equal
rows change places freely. Texts are never cut but into pieces. A table without rows gives none. Columns in
``keep`` pass through; names beginning with ``_pk_`` are the operator's own.
"""

from __future__ import annotations

import functools
import json
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwatch.llm.common import Remembered, per_text, slices, table
from tarnwatch.operators.scan import running

CAPACITY, END_ID = 4096, 1
#: Words that a worker remembers in each of two generations, some 130 bytes each.
REMEMBERED = 400_000
#: Characters that lower-casing and composing change one by one and whose white space is the same everywhere:
#: texts of these alone are encoded word by word, all others whole.
PLAIN = re.compile("[\t-\r\x20-\x7e\xa0-ɏ‐-‧‰-⁞]*")


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers, for tokenizers that drop white space.

    What stands between white space is encoded once and remembered. Where the tokenizer splits runs of letters from
    all else before its merges (as its file says), letters go to the merges directly.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        steps = (json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.splits_letters = [s["type"] for s in steps] == ["Split", "ByteLevel"] and "|[\\p{L}]+|" in steps[0]["pattern"].get("Regex", "")
        self.merges = self.tokenizer.model
        self.words = Remembered(self.word, REMEMBERED)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        if self.splits_letters and word.isascii():
            if word.isalpha():
                return b"".join([t.id.to_bytes(4, "little") for t in self.merges.tokenize(word)])
            if word[:-1].isalpha():
                return self.words[word[:-1]] + self.words[word[-1]]
        return self.whole(word)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not PLAIN.fullmatch(text) or any(s in text for s in self.specials):
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, text.lower().split()))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY,
           end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``keep`` + _pk_row, _pk_piece, _pk_start, _pk_length, _pk_crc32 and, if asked for, _pk_ids."""
    end, size = np.array([end_id], "<u4").tobytes(), 4 * capacity
    part = T.StructType([T.StructField("crc32", T.LongType()), T.StructField("length", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(texts):
        out = []
        for t in texts:
            ids = encoder(path).encode(t) + end
            parts = [ids[i:i + size] for i in range(0, len(ids), size)]
            out.append([{"crc32": zlib.crc32(p), "length": len(p) // 4, "ids": np.frombuffer(p, "<u4").tolist() if with_ids else None} for p in parts])
        return [out]

    numbered = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])], F.monotonically_increasing_id().alias("_pk_row"))
    cut = per_text(numbered, text, [T.StructField("_pk_parts", T.ArrayType(part))], run, [*keep, "_pk_row"])
    rows = cut.select(*[F.col(f"`{c}`") for c in keep], "_pk_row", F.posexplode("_pk_parts").alias("_pk_piece", "_pk_part"))
    return rows.select(*[F.col(f"`{c}`") for c in keep], "_pk_row", "_pk_piece", (F.col("_pk_piece").cast("long") * capacity).alias("_pk_start"),
                       F.col("_pk_part.length").alias("_pk_length"), F.col("_pk_part.crc32").alias("_pk_crc32"),
                       *([F.col("_pk_part.ids").alias("_pk_ids")] if with_ids else []))


class OpenSequences:
    """Runs of open sequences by remaining capacity, under a segment tree that knows which capacities have any."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def push(self, room: int, first: int, number: int) -> None:
        if room and number:
            self.runs[room].append((first, number))
            self._mark(room)

    def pop(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        self._mark(room)
        return run

    def _mark(self, room: int) -> None:
        node, any_ = room + self.leaves, self.any
        any_[node] = bool(self.runs[room])
        while node := node >> 1:
            any_[node] = any_[2 * node] | any_[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity that holds ``length``."""
        node, any_ = length + self.leaves, self.any
        while not any_[node]:
            while node & 1:  # a right child: what follows is under an ancestor
                node >>= 1
            if not node:
                return None
            node += 1  # the sibling to the right
        while node < self.leaves:
            node = 2 * node if any_[2 * node] else 2 * node + 1
        return node - self.leaves


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, from rank, pieces a sequence, first sequence, offset) by length and rank, and the number of sequences."""
    rows, opened, sequences = [], OpenSequences(capacity), 0
    for length in sorted(counts, reverse=True):
        left, done = counts[length], 0
        while left:
            room = opened.tightest(length)
            if room is None:  # as many new ones as the rest of this length fills
                room, first, number = capacity, sequences, -(-left // (capacity // length))
                sequences += number
            else:
                first, number = opened.pop(room)
            fit = room // length  # best fit goes on with the sequence it has just made tighter
            for each, of in ((fit, min(number, left // fit)), (left % fit, 1)):
                if each and of and number and left:
                    rows.append((length, done, each, first, capacity - room))
                    opened.push(room - each * length, first, of)
                    left, done, first, number = left - each * of, done + each * of, first + of, number - of
                if left >= fit:
                    break  # this run is used up; the next tightest follows
            opened.push(room, first, number)
    return np.array(sorted(rows), np.int64).reshape(-1, 5), sequences


RANK_BITS = 44  # ranks below 2**44, lengths below 2**19


def pack(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY,
         end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The rows of ``pieces`` with _pk_sequence and _pk_offset."""
    spark = docs.sparkSession
    found = table(pieces(docs, path, text, keep, capacity, end_id, with_ids), "pk_pieces")
    counts = {r["_pk_length"]: r["count"] for r in found.groupBy("_pk_length").count().collect()}  # at most ``capacity`` rows
    steps, _ = plan(counts, capacity)
    widths = spark.createDataFrame([(n, math.isqrt(c) + 1) for n, c in counts.items()], "_pk_length int, _pk_width int")
    dealt = found.join(F.broadcast(widths), "_pk_length").withColumn(
        "_pk_bucket", F.pmod(F.xxhash64("_pk_row", "_pk_piece"), F.col("_pk_width")))
    ranked = running(dealt, ["_pk_length"], ["_pk_bucket", "_pk_row", "_pk_piece"], F.col("_pk_bucket"), {"_pk_rank": ("count", F.lit(1))})
    ranked = ranked.select(*[F.col(f"`{c}`") for c in found.columns], (F.col("_pk_rank") - 1).alias("_pk_rank"))
    shared = spark.sparkContext.broadcast(steps)
    names = found.columns
    schema = T.StructType([*found.schema, T.StructField("_pk_sequence", T.LongType()), T.StructField("_pk_offset", T.LongType())])

    def place(batches):
        rows = shared.value
        keys = rows[:, 0] << RANK_BITS | rows[:, 1]
        for batch in slices(batches):
            length = batch.column("_pk_length").to_numpy().astype(np.int64)
            rank = batch.column("_pk_rank").to_numpy()
            step = rows[np.searchsorted(keys, length << RANK_BITS | rank, "right") - 1]
            nth = rank - step[:, 1]
            arrays = [batch.column(c) for c in names]
            arrays += [pa.array(step[:, 3] + nth // step[:, 2]), pa.array(step[:, 4] + nth % step[:, 2] * length)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """_pk_sequence, _pk_tokens, _pk_ids: the packed sequences themselves, from ``pack(..., with_ids=True)``.

    A group is one sequence, so it holds ``capacity`` ids at most.
    """
    parts = F.array_sort(F.collect_list(F.struct("_pk_offset", "_pk_ids")))
    return packed.groupBy("_pk_sequence").agg(F.sum("_pk_length").alias("_pk_tokens"), F.flatten(F.transform(parts, lambda p: p["_pk_ids"])).alias("_pk_ids"))
