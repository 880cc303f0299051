"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwatch.session import ensure_checkpoint_dir

SPACES = " \t\n\x0b\f\r"  # the characters that separate words in every contract
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Distinct words that one Python worker remembers in each of two generations.
REMEMBER = 150_000
#: Rows that Python handles at a time.
SLICE = 500


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that the cluster shares (``spark.checkpoint.dir``)."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and its size is known to the planner."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key written as text, modulo ``folds``; null for a null key."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(folds)).cast("int")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; everything else stays."""
    return F.translate(text, UPPER, LOWER)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that Python objects exist for a few hundred texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def per_text(df: DataFrame, text: str, fields: list[T.StructField],
             fn: Callable[[list[str | None]], list[list]], keep: list[str]) -> DataFrame:
    """Add columns that ``fn`` computes from one text column, Arrow batch by Arrow batch.

    ``fn`` gets the texts of a batch and returns one list of values per field. Only the columns in
    ``keep`` travel through Python besides the text, so the output is ``keep`` + ``fields``.
    """
    schema = T.StructType([*[df.select(F.col(f"`{c}`")).schema[0] for c in keep], *fields])
    at = keep.index(text) if text in keep else len(keep)  # a text that is kept travels once
    source = df.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate([*keep, text][:max(len(keep), at + 1)])])
    types = [T.StructField(f.name, f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in slices(batches):
            values = fn(batch.column(at).to_pylist())
            arrays = [batch.column(i) for i in range(len(keep))]
            arrays += [pa.array(v, type=to_arrow_type(t.dataType)) for v, t in zip(values, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)


class Remembered(dict):
    """Results by word; when there are too many, those not used since the last such moment are forgotten."""

    def __init__(self, fn, limit: int = REMEMBER):
        super().__init__()
        self.fn, self.older, self.limit = fn, {}, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        out = self.older.get(key)
        if out is None:
            out = self.fn(key)
        if len(key) <= 64:
            self[key] = out
        return out
