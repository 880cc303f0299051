"""Helpers for registering queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Book:
    """Queries and oracle SQL of one plan module."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracle: dict = {}

    def add(self, name: str, fn, sql: str | None = None) -> None:
        self.queries[name] = fn
        if sql is not None:
            self.oracle[name] = sql


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round double columns so both engines agree on the last digits."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if f.dataType.simpleString() == "double"
        else F.col(f"`{f.name}`") for f in df.schema.fields])
