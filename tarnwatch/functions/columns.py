"""Small column builders used across the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def lookup(key, table: dict, default=None) -> Column:
    """Constant-table lookup as an in-plan map, so it stays inside codegen."""
    mapping = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(mapping, col(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def cases(pairs, default) -> Column:
    """``CASE WHEN`` chain from (condition, value) pairs."""
    expr = reduce(lambda acc, p: acc.when(p[0], p[1]) if acc is not None else F.when(p[0], p[1]),
                  pairs, None)
    return expr.otherwise(default)


def without_nan(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN is a gap like NULL: in floating columns it becomes NULL, so that no statistic sees it."""
    floating = {name for name, kind in df.dtypes if kind in ("double", "float")}
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in columns if c in floating})


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields 0 when the denominator is 0."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(
        numerator.cast("double") / denominator.cast("double"))


def seconds(ts) -> Column:
    """Timestamp as fractional epoch seconds (microsecond precision)."""
    return F.unix_micros(col(ts)) / F.lit(1e6)


def sorted_join(items, sep: str = ",") -> Column:
    return F.array_join(F.array_sort(items), sep)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def safe_corr(a, b) -> Column:
    """Pearson correlation over rows where both are present; NULL when either is constant."""
    x, y = col(a).cast("double"), col(b).cast("double")
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_pop(x, y),
                        F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))
