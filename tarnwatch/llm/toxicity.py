"""Toxicity by a factorization machine over hashed terms (operator 6).

A text's terms are its lower-cased words and their first 4 and 5 letters, hashed. Its score is

    sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>)

over the distinct terms it holds, so a pair of terms (an insult and the mention of a group) can count
for more or less than both alone, which additive weights cannot express. Terms are left out before fitting if
neither their share among toxic and other training texts differs clearly nor that of texts with a pair of them
more clearly than either alone. During fitting terms are
dropped at random, a different share of each text in each round, so that one term alone suffices where
training texts hold several.

Training uses a bounded sample of ``PER_CLASS`` texts of each class, chosen by hash, without copies of toxic
texts: those whose three-word shingles are ``COPY`` similar to an earlier one's. Similarity is exact up to ``SKETCH``
shingles and estimated from the least ``SKETCH`` hashes beyond. Scoring reads whole texts. Null and empty texts have no terms and get the model's base score, always below 0.5;
without labelled texts of both classes every score is the share of toxic ones (0 if none). Rows with
null keys or equal texts pass through alike; a table without rows gives none.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from hashlib import blake2b
from heapq import nsmallest
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwatch.llm.common import Remembered, per_text
from tarnwatch.llm.langid import sample_by_label

#: Labelled texts of each class that training reads at most (about).
PER_CLASS = {0: 8_000, 1: 4_000}
BUCKETS = 1 << 20
TERMS, FACTORS = 512, 8
#: Weight of all toxic texts in fitting; under a half, as wrongly marked texts cost more.
TOXIC_WEIGHT = 0.35
#: A term or pair of terms must be in this many training texts of a class.
LEAST = 5
#: Hashes kept of a text's shingles, and the similarity from which it is a copy.
SKETCH, COPY = 256, 0.8
#: Standard errors by which a term's two shares must differ.
CLEAR = 6.0
#: Terms, the clearest alone, whose pairs are counted, and by how much a pair must be clearer than its terms.
PAIRED, CLEARER = 2_048, 1.0
WORD = re.compile(r"[^\W\d_]+")  # runs of letters


def buckets(word: str) -> list[int]:
    data = word.encode()
    return [crc32(data) % BUCKETS, *(crc32(word[:n].encode(), n) % BUCKETS for n in (4, 5) if len(word) >= n)]


def terms_of(text: str | None) -> list[int]:
    return sorted({b for w in set(WORD.findall(text.lower())) for b in buckets(w)}) if text else []


@dataclass
class Model:
    terms: np.ndarray  # bucket numbers, sorted
    w0: float
    w: np.ndarray
    v: np.ndarray

    def __post_init__(self):
        self.place = {int(b): i for i, b in enumerate(self.terms)}
        self.known = Remembered(self.of_word)

    def __reduce__(self):
        return Model, (self.terms, self.w0, self.w, self.v)

    def of_word(self, word: str) -> tuple[int, ...]:
        return tuple(self.place[b] for b in buckets(word) if b in self.place)

    def score(self, text: str | None) -> float:
        held = set()
        if text:
            held.update(chain.from_iterable(map(self.known.__getitem__, set(WORD.findall(text.lower())))))
        y = self.w0
        if held:
            i = np.fromiter(sorted(held), dtype=np.int64)
            total = self.v[i].sum(0)
            y += float(self.w[i].sum() + 0.5 * (total @ total - (self.v[i] ** 2).sum()))
        return float(1 / (1 + np.exp(-np.clip(y, -30, 30))))


def sketch_of(text: str | None) -> list[int]:
    """The least hashes of a text's distinct three-word shingles (of the whole text if it is shorter)."""
    words = text.lower().split() if text else []
    found = {blake2b(" ".join(words[i:i + 3]).encode("utf-8", "surrogatepass"), digest_size=7).digest() for i in range(max(1, len(words) - 2))} if words else ()
    return sorted(int.from_bytes(d, "big") for d in nsmallest(SKETCH, found))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of the shingles of two sketches."""
    union = np.union1d(a, b)
    if max(len(a), len(b)) == SKETCH:  # what is beyond the least of both is not known of both
        union = union[:SKETCH]
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True)) / max(1, len(union))


def without_copies(sketches: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Which texts to fit on: not those toxic ones that are copies of an earlier toxic text that stays.

    Else whatever words a copied toxic text happens to hold would look toxic.
    """
    keep, holders, met = np.ones(len(y), dtype=bool), {}, []
    for row in np.nonzero(y == 1)[0]:
        held = np.asarray(sketches[row], dtype=np.int64)
        shared = np.bincount(np.concatenate([np.zeros(0, np.int64), *[holders[h] for h in held.tolist() if h in holders]]), minlength=len(met))
        likely = np.nonzero(shared * 2 >= max(1, len(held)))[0]  # COPY needs more than half in common
        keep[row] = not any(similarity(held, met[m]) >= COPY for m in likely)
        if keep[row]:
            for h in held.tolist():
                holders.setdefault(h, array("q")).append(len(met))
            met.append(held)
    return keep


def rows_of(x_terms: list[np.ndarray], terms: np.ndarray) -> np.ndarray:
    """A 0/1 matrix of which texts hold which of the sorted terms."""
    x = np.zeros((len(x_terms), len(terms)), dtype=np.uint8)
    for row, held in enumerate(x_terms):
        held = np.asarray(held, dtype=np.int64)
        at = np.searchsorted(terms, held)
        ok = at < len(terms)
        ok[ok] = terms[at[ok]] == held[ok]
        x[row, at[ok]] = 1
    return x


def clearness(c0: np.ndarray, c1: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Root of the likelihood ratio that two shares are equal: standard errors, but right for small counts too."""
    c0, c1 = c0.astype(np.float64), c1.astype(np.float64)
    p = (c0 + c1) / (n0 + n1)
    part = lambda c, n, q: np.where(c > 0, c * np.log(np.maximum(c, 1e-300) / np.maximum(n * q, 1e-300)), 0.0)
    g = part(c1, n1, p) + part(n1 - c1, n1, 1 - p) + part(c0, n0, p) + part(n0 - c0, n0, 1 - p)
    return np.sqrt(np.maximum(2 * g, 0))


def pair_clearness(x_terms: list[np.ndarray], y: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """By term, how clearly its best pair's joint shares differ; 0 unless more clearly than either term's own."""
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())
    joint = []
    for k in (0, 1):
        total = np.zeros((len(terms), len(terms)), dtype=np.float32)  # counts under 2**24 are exact
        rows = [t for t, c in zip(x_terms, y, strict=True) if c == k]
        for at in range(0, len(rows), 1000):
            part = rows_of(rows[at:at + 1000], terms).astype(np.float32)
            total += part.T @ part
        joint.append(total)
    own = clearness(joint[0].diagonal(), joint[1].diagonal(), n0, n1)
    best = np.zeros(len(terms))
    for i in range(len(terms)):
        c0, c1 = joint[0][i], joint[1][i]
        z = np.where(np.maximum(c0, c1) >= LEAST, clearness(c0, c1, n0, n1), 0)
        best[i] = z[z > np.maximum(own, own[i]) + CLEARER].max(initial=0)
    return best


def choose_terms(x_terms: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Buckets whose document shares, alone or in a pair, differ clearly between the classes, the clearest first, at most TERMS."""
    count = [np.bincount(np.concatenate([t for t, c in zip(x_terms, y, strict=True) if c == k]).astype(np.int64),
                         minlength=BUCKETS) for k in (0, 1)]
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    pooled = (count[0] + count[1]) / (n0 + n1)
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n0 + 1 / n1))
    z = np.where(np.maximum(count[0], count[1]) >= LEAST, np.abs(count[1] / n1 - count[0] / n0) / error, 0)
    often = np.nonzero(np.maximum(count[0], count[1]) >= LEAST)[0]
    paired = np.sort(often[np.argsort(-z[often], kind="stable")[:PAIRED]])
    z[paired] = np.maximum(z[paired], pair_clearness(x_terms, y, paired))
    best = np.argsort(-z, kind="stable")[:TERMS]
    return np.sort(best[z[best] > CLEAR])


def fit(x_terms: list[np.ndarray], y: np.ndarray, rounds: int = 60, seed: int = 11, sketches: list[np.ndarray] | None = None) -> Model:
    if sketches is not None:
        keep = without_copies(sketches, y)
        x_terms, y = [t for t, k in zip(x_terms, keep, strict=True) if k], y[keep]
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())
    if not n0 or not n1:
        share = np.clip(n1 / max(1, n0 + n1), 1e-9, 1 - 1e-9)
        return Model(np.zeros(0, np.int64), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, FACTORS)))
    terms = choose_terms(x_terms, y)
    x = rows_of(x_terms, terms)
    rng = np.random.default_rng(seed)
    w0, w = np.zeros(1), np.zeros(len(terms))
    v = rng.normal(0, 0.02, (len(terms), FACTORS))
    squares = [np.full_like(p, 1e-6) for p in (w0, w, v)]
    weight = np.where(y == 1, TOXIC_WEIGHT / n1, (1 - TOXIC_WEIGHT) / n0) * len(y)
    sign = np.where(y == 1, 1.0, -1.0)
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 200)):
            a = x[part] * (rng.random((len(part), 1)) + 0.1 > rng.random((len(part), len(terms))))
            total = a @ v
            score = w0[0] + a @ w + 0.5 * ((total**2).sum(1) - (a @ v**2).sum(1))
            g = -weight[part] * sign[part] / (1 + np.exp(np.clip(sign[part] * score, -30, 30))) / len(part)
            grads = (np.array([g.sum()]), a.T @ g + 1e-5 * w,
                     a.T @ (g[:, None] * total) - (a.T @ g)[:, None] * v + 1e-4 * v)
            for p, grad, sq in zip((w0, w, v), grads, squares, strict=True):
                sq += grad * grad
                p -= 0.3 * grad / np.sqrt(sq)
    return Model(terms, float(min(w0[0], -0.1)), w, v)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on a sample of the labels 0 and 1.

    The sample is drawn before its texts are looked up, so that it, of known size, is what is sent around;
    executors return the hashed terms only, and of toxic texts their sketches. A key counts once for each of its
    labels, with its smallest text, however often it is repeated in either table.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    known = F.broadcast(sample_by_label(known, "label", ["key"], PER_CLASS).distinct())  # about the sum of PER_CLASS in rows
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(known, "key")
    rows = rows.groupBy("key", "label").agg(F.min("text").alias("text"))
    fields = [T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("sketch", T.ArrayType(T.LongType()))]
    held = per_text(rows, "text", fields, lambda texts: [[terms_of(t) for t in texts], [sketch_of(t) for t in texts]], ["key", "label"])
    held = held.withColumn("sketch", F.when(F.col("label") == 1, F.col("sketch"))).toArrow().sort_by([("key", "ascending")])
    y = held.column("label").to_numpy().astype(np.int64)
    return fit(lists(held, "terms"), y, sketches=lists(held, "sketch"))


def lists(frame: pa.Table, name: str) -> list[np.ndarray]:
    """The rows of a list column as arrays; none for null."""
    column = frame.combine_chunks().column(name).combine_chunks()
    bounds, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` + score (0 to 1), predicted int (score >= 0.5)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded: TERMS x (FACTORS + 2)

    def run(texts):
        found = [shared.value.score(t) for t in texts]
        return [found, [int(s >= 0.5) for s in found]]

    return per_text(df, text, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())],
                    run, list(keep))
