"""Language identification by error-correcting output codes (operator 5).

Every language gets a codeword of +1 and -1. For each bit a binary logistic classifier over hashed
character n-grams learns whether a text's language has +1 there. A text's language is the one whose
codeword has the least loss against the bits' scores, bits weighted by their accuracy on training
texts put aside; a small distance to the second best marks the answer as ambiguous.

Training uses a bounded sample: about ``PER_LANGUAGE`` distinct texts of each language, chosen by hash, so a text counts
once however often it is copied. Executors compute its features; the texts stay there. Features are
the letters of the whole text, lower-cased, with one blank for every run of other characters; n-grams
of 1 to 3 characters, square roots of their counts, unit length.

Texts that are null, empty or without a letter get ``und`` with score 0. Null keys pass through, equal
texts get equal answers, a table without rows gives none. Without labelled rows every text is ``und``;
with one language every text with a letter gets it. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwatch.llm.common import per_text

UNKNOWN = "und"
#: Labelled texts of each language that training reads at most (about).
PER_LANGUAGE = 1_000
BUCKETS = 4_096  # a power of two
#: Differences of mean loss under this are ambiguous.
MARGIN = 0.02
_LETTER = np.zeros(0x110000, dtype=bool)


def letters() -> np.ndarray:
    """Which code points are letters (filled once per process)."""
    if not _LETTER.any():
        _LETTER[:] = [chr(i).isalpha() for i in range(0x110000)]
    return _LETTER


def ngram_buckets(text: str) -> np.ndarray:
    """Bucket numbers of all n-grams of a text's letters; empty if it has none."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters()[points]
    if not is_letter.any():
        return np.zeros(0, dtype=np.int64)
    points = np.where(is_letter, points, 32)
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]  # the first of a run of blanks stays
    points = np.concatenate([[32], points[keep], [32]]).astype(np.uint32)
    out, rolled = [], np.zeros(len(points), dtype=np.uint32)
    for n in range(1, 4):
        rolled = rolled[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1:] + np.uint32(n)
        mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out.append((mixed ^ (mixed >> np.uint32(13))) & np.uint32(BUCKETS - 1))
    return np.concatenate(out).astype(np.int64)


def features(text: str) -> np.ndarray | None:
    found = ngram_buckets(text)
    if not len(found):
        return None
    x = np.sqrt(np.bincount(found, minlength=BUCKETS).astype(np.float32))
    return x / np.linalg.norm(x)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """(n, bits) of +1 and -1: all different splits for up to five languages, else random words far apart."""
    if n <= 5:
        splits = [[1, *(1 if s >> i & 1 else -1 for i in range(n - 1))] for s in range(2 ** (n - 1) - 1)]
        return np.array(splits, dtype=np.float32).reshape(-1, n).T
    rng, bits = np.random.default_rng(seed), math.ceil(10 * math.log2(n))
    draws = [np.where(rng.random((n, bits)) < 0.5, -1, 1) for _ in range(40)]
    apart = lambda m: min((bits - m @ m.T + bits * 2 * np.eye(n, dtype=int)).ravel())
    best = max(draws, key=apart)
    return best[:, np.abs(best.sum(0)) < n].astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous)"""
        x = features(text) if text and self.languages else None
        if x is None:
            return UNKNOWN, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margins = x @ self.weights + self.bias
        loss = np.logaddexp(0, -self.codes * margins) @ self.trust
        order = np.argsort(loss, kind="stable")
        likely = np.exp(-4 * (loss - loss[order[0]]))
        return (self.languages[order[0]], float(1 / likely.sum()), bool(loss[order[1]] - loss[order[0]] < MARGIN))


def sample_by_label(df: DataFrame, label: str, key: list[str], most: int | dict) -> DataFrame:
    """About ``most`` rows of each label (or of each by its own number), chosen by a hash of ``key``."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, (most[k] if isinstance(most, dict) else most) / n))]) if counts else None
    drawn = F.pmod(F.xxhash64(*key, F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.where(drawn < share[F.col(label)]) if counts else df.limit(0)


def drawn_texts(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, text of about PER_LANGUAGE distinct texts of each language."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    counts = {r[0]: max(r[1], 1) for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02)).collect()}
    if not counts:
        return rows.withColumn("same", F.lit("")).limit(0)
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, PER_LANGUAGE / n))])
    drawn = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn_rows = rows.where(drawn < share[F.col("lang")]).withColumn("same", F.sha2("text", 256))
    return drawn_rows.groupBy("lang", "same").agg(F.first("text").alias("text"))  # equal texts; one stays on each side of the shuffle


def packed(text: str) -> bytes | None:
    """The features that are not 0, as places and values."""
    x = features(text)
    if x is None:
        return None
    at = np.flatnonzero(x)
    return at.astype(np.uint16).tobytes() + x[at].tobytes()


def unpacked(data: bytes, x: np.ndarray) -> None:
    n = len(data) // 6
    x[np.frombuffer(data, np.uint16, n)] = np.frombuffer(data, np.float32, n, 2 * n) if n % 2 == 0 else np.frombuffer(data[2 * n:], np.float32)


def training_features(texts: list[str]) -> list[list]:
    """By text, the packed features of the whole and of a few words, for short texts."""
    whole, few = [], []
    for text in texts:
        words = text.split()
        middle = len(words) // 2
        whole.append(packed(text))
        few.append(packed(" ".join(words[middle:middle + 1 + len(text) % 6])))
    return [whole, few]


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", rounds: int = 150) -> Model:
    """Fit on the rows of ``labelled`` whose text and language are known."""
    found = per_text(drawn_texts(labelled, text, lang), "text", [T.StructField("whole", T.BinaryType()), T.StructField("few", T.BinaryType())], training_features,
                     ["lang", "same"]).toArrow().sort_by([("lang", "ascending"), ("same", "ascending")])
    data = []
    for lang_, *pieces in zip(*[found.column(c) for c in ("lang", "whole", "few")], strict=True):
        data += [(lang_.as_py(), p.as_py()) for p in pieces if p.is_valid]
    languages = sorted({lang_ for lang_, _ in data})
    codes = codewords(len(languages)) if len(languages) > 1 else np.zeros((len(languages), 0), dtype=np.float32)
    bits = codes.shape[1]
    w, b = np.zeros((BUCKETS, bits), dtype=np.float32), np.zeros(bits, dtype=np.float32)
    if not bits:
        return Model(languages, codes, w, b, np.ones(0, dtype=np.float32))
    x = np.zeros((len(data), BUCKETS), dtype=np.float32)
    for filled, (_, f) in zip(x, data, strict=True):
        unpacked(f, filled)
    row = np.array([languages.index(lang_) for lang_, _ in data])
    y = codes[row]
    share = 1 / np.bincount(row)[row]  # every language weighs the same
    aside = np.arange(len(x)) % 5 == 0
    m = [np.zeros_like(w), np.zeros_like(b)]
    v = [np.zeros_like(w), np.zeros_like(b)]
    fit = np.where(aside & (np.bincount(row)[row] >= 10), 0, share)
    fit = (fit / fit.sum()).astype(np.float32)[:, None]
    for t in range(1, rounds + 1):  # Adam, whole sample
        g = -fit * y / (1 + np.exp(y * (x @ w + b)))
        for i, (p, grad) in enumerate(((w, x.T @ g + 1e-6 * w), (b, g.sum(0)))):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.99 * v[i] + 0.01 * grad * grad
            p -= 0.3 * m[i] / (1 - 0.9**t) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    right = ((x @ w + b) * y > 0)[aside].mean(0)
    trust = np.log(np.clip(right, 0.55, 0.999) / (1 - np.clip(right, 0.55, 0.999)))
    return Model(languages, codes, w, b, (trust / trust.sum()).astype(np.float32))


def identify(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` + lang_pred, score (0 to 1), ambiguous."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS x bits

    def run(texts):
        found = [shared.value.predict(t) for t in texts]
        return [[f[i] for f in found] for i in range(3)]

    return per_text(df, text, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                               T.StructField("ambiguous", T.BooleanType())], run, list(keep))


def accepted(spark: SparkSession, text: Column, model: Model) -> Column:
    """Whether a text has a language that is not ambiguous. The text itself does not come back from Python."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def accept(texts: pd.Series) -> pd.Series:
        found = map(shared.value.predict, texts)
        return pd.Series([lang != UNKNOWN and not ambiguous for lang, _, ambiguous in found], dtype=bool)

    return accept(text)


def learnable(fold: Column, held_out: int) -> Column:
    """Rows that training may read: those of a known other fold."""
    return F.coalesce(fold != held_out, F.lit(False))
