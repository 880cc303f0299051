"""Byte-level BPE by forced boundaries (operator 3).

A pair of neighbouring bytes that occurs inside no token of the vocabulary can never end up inside
one token, so a cut between the two is certain whatever the merges do. Every word piece of the
pre-tokenizer is cut there, the fragments are encoded on their own (and remembered, as they are
short and repeat) and their ids are concatenated. No merge crosses a piece of the pre-tokenizer
either, so pieces are the outer cuts; they come first because contractions depend on what stands
before them.

Nulls count as the empty text, which has no tokens. Texts of any length are encoded whole: the merge
loop keeps a heap, so a fragment without any certain cut costs n log n. Repeated rows and null ids
pass through, tables without rows give none, and extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from itertools import chain, pairwise

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarnwatch.llm.common import Remembered, per_text

BITS, NEVER = 24, 1 << 60  # an id's room in a number, and more than any rank
LOW = (1 << BITS) - 1
#: Fragments up to this many bytes are merged by plain search, longer ones with a heap.
SHORT = 24
# fixed value: the pre-tokenizer pattern of byte-level BPE vocabularies, with white space as the Unicode property
PIECES = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
          r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Codec:
    """A vocabulary with its merges, its certain cuts and what has been encoded so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if (model["type"], pre.get("type"), spec["normalizer"], pre.get("add_prefix_space"), pre.get("use_regex")) != (
                "BPE", "ByteLevel", None, False, True):
            raise ValueError(f"{path}: only plain byte-level BPE vocabularies are known")
        value = {c: b for b, c in enumerate(byte_letters())}
        as_bytes = lambda token: bytes(value[c] for c in token)
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: by pair of ids: the merge's rank and the id that it makes, in one number that sorts by rank
        self.ranks = {}
        for rank, (a, b) in enumerate(merges):
            a, b = as_bytes(a), as_bytes(b)
            self.ranks[self.ids[a] << BITS | self.ids[b]] = rank << BITS | self.ids[a + b]
        self.bytes = [self.ids[bytes([b])] for b in range(256)]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.special = {}
        for t in spec["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]:
                raise ValueError(f"{path}: the added token {t['content']!r} has options that are not known")
            self.special[t["content"]] = t["id"]
            self.tokens[t["id"]] = t["content"].encode()
        names = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.marks = regex.compile(f"({'|'.join(names)})") if names else None
        self.joined = bytearray(1 << 16)
        for t in self.ids:
            for a, b in pairwise(t):
                self.joined[a << 8 | b] = 1
        self.pieces = regex.compile(PIECES)
        self.known = Remembered(self.encode_piece)
        self.written = {i: str(i) for i in self.tokens}

    def fragments(self, data: bytes) -> list[bytes]:
        """Cut between all neighbouring bytes that no token joins."""
        joined, start, out = self.joined, 0, []
        for i, (a, b) in enumerate(pairwise(data), 1):
            if not joined[a << 8 | b]:
                out.append(data[start:i])
                start = i
        return [*out, data[start:]] if data else []

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.merge, self.fragments(piece.encode()))))

    def merge(self, data: bytes) -> list[int]:
        """Apply the merges to one fragment, lowest rank first, leftmost first among equals."""
        parts = [self.bytes[b] for b in data]
        if len(parts) > SHORT:
            return self.merge_long(parts)
        rank = self.ranks.get
        ranks = [rank(a << BITS | b, NEVER) for a, b in pairwise(parts)]
        while ranks and (best := min(ranks)) != NEVER:
            i = ranks.index(best)
            parts[i] = best & LOW
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] << BITS | parts[i + 1], NEVER)
            if i:
                ranks[i - 1] = rank(parts[i - 1] << BITS | parts[i], NEVER)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap and links between neighbours, for n log n."""
        rank, n = self.ranks.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(pairwise(parts)) if (r := rank(a << BITS | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = r & LOW, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := rank(parts[left] << BITS | parts[right])) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.marks is None or not self.marks.search(text):
            return list(chain.from_iterable(map(self.known.__getitem__, self.pieces.findall(text))))
        out: list[int] = []
        for part in self.marks.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += chain.from_iterable(map(self.known.__getitem__, self.pieces.findall(part)))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` + ids array<int>, n_tokens long."""
    def run(texts):
        ids = [codec(path).encode(t) for t in texts]
        return [ids, [len(x) for x in ids]]

    return per_text(df, text, [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())],
                    run, list(keep))


def decode(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` + decoded string; bytes that are no UTF-8 become replacement characters, null ids an empty text."""
    return per_text(df, ids, [T.StructField("decoded", T.StringType())],
                    lambda rows: [[codec(path).decode(x or []) for x in rows]], list(keep))


def round_trip(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` + n_tokens, ids_sha256, decoded_sha256: encode, decode the ids again and digest both, in one pass."""
    def run(texts):
        c, n, a, b = codec(path), [], [], []
        for t in texts:
            ids = c.encode(t)
            n.append(len(ids))
            a.append(sha256(",".join(map(c.written.__getitem__, ids))))
            b.append(sha256(c.decode(ids)))
        return [n, a, b]

    return per_text(df, text, [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                               T.StructField("decoded_sha256", T.StringType())], run, list(keep))
