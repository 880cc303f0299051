"""Exact order statistics without gathering a column in one place."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.functions.columns import without_nan

# up to this many rows the built-in exact percentile is used directly
DIRECT_ROWS = 1_000_000
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float],
                    direct_rows: int = DIRECT_ROWS) -> dict[str, list[float | None]]:
    """Interpolated quantiles per column, as the usual exact definition gives them; NaN counts as missing.

    Small inputs (counted first) take one built-in aggregate. Larger ones narrow a
    bracket around every wanted rank: each pass is a single aggregation over all
    open brackets that returns a few numbers per bracket and shrinks it by a factor
    of several thousand, until what is left fits a bounded read.
    """
    if not columns:
        return {}
    df = without_nan(df, columns)
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    sizes = dict(zip(columns, counts))
    if max(sizes.values()) <= direct_rows:
        probs = F.array(*[F.lit(float(p)) for p in probabilities])
        row = df.agg(*[F.percentile(F.col(f"`{c}`").cast("double"), probs).alias(f"q{i}")
                       for i, c in enumerate(columns)]).first()
        return {c: [None] * len(probabilities) if row[i] is None else list(row[i])
                for i, c in enumerate(columns)}

    ranks = {(c, r) for c in columns if sizes[c] for p in probabilities
             for r in (math.floor(p * (sizes[c] - 1)), math.ceil(p * (sizes[c] - 1)))}
    values = _order_statistics(df, ranks, direct_rows)
    out: dict[str, list[float | None]] = {}
    for c in columns:
        out[c] = []
        for p in probabilities:
            if not sizes[c]:
                out[c].append(None)
                continue
            at = p * (sizes[c] - 1)
            lo, hi = values[c, math.floor(at)], values[c, math.ceil(at)]
            out[c].append(lo + (hi - lo) * (at - math.floor(at)))
    return out


def _order_statistics(df: DataFrame, targets: set[tuple[str, int]], direct_rows: int) -> dict:
    """Values at the wanted ranks. A bracket is open: its ends are cut points whose own rows were counted and ruled out.

    Every pass cuts a bracket at two of its values and counts what lies at, between and outside them. The rank is
    then at a cut point or in one of three brackets without it, so a pass never leaves a bracket as it was, however
    often a value repeats and wherever the approximate cut points fall.
    """
    found: dict[tuple[str, int], float] = {}
    limit = min(direct_rows, 100_000) or 100

    def within(c, lo, hi):
        v = F.col(f"`{c}`").cast("double")
        inside = v.isNotNull()
        inside = inside if lo is None else inside & (v > lo)
        return v, inside if hi is None else inside & (v < hi)

    # (column, low end, high end, rows inside) -> (rank of the column, rank inside) pairs
    brackets: dict[tuple, list[tuple[int, int]]] = {}
    for c in sorted({c for c, _ in targets}):
        brackets[c, None, None, None] = [(r, r) for t, r in sorted(targets) if t == c]
    while brackets:
        for key in [k for k in brackets if k[3] is not None and k[3] <= limit]:
            v, inside = within(*key[:3])
            rows = df.where(inside).groupBy(v.alias("v")).agg(F.count("*").alias("n")).orderBy("v").collect()
            for rank, position in brackets.pop(key):
                for row in rows:
                    if position < row["n"]:
                        found[key[0], rank] = row["v"]
                        break
                    position -= row["n"]
        if not brackets:
            break
        # a cut around each rank; the size of a whole column is counted with its first cuts
        work = [(key, rank, position) for key, ranks in brackets.items() for rank, position in ranks]
        sizes = {key: key[3] for key in brackets}
        fresh = [key for key in brackets if key[3] is None]
        if fresh:
            counts = df.agg(*[F.count(within(*key[:3])[0]).alias(f"c{i}") for i, key in enumerate(fresh)]).first()
            sizes.update(zip(fresh, counts))
        margin = 3.0 / ACCURACY
        aggs = []
        for i, (key, _, position) in enumerate(work):
            v, inside = within(*key[:3])
            share = position / sizes[key]
            aggs.append(F.percentile_approx(F.when(inside, v), [max(share - margin, 0.0), min(share + margin, 1.0)], ACCURACY).alias(f"a{i}"))
        cuts = df.agg(*aggs).first()
        aggs = []
        for i, (key, *_) in enumerate(work):
            (v, inside), (low, high) = within(*key[:3]), cuts[f"a{i}"]
            aggs += [F.count(F.when(inside & test, 1)).alias(f"{name}{i}") for name, test in (
                ("under", v < low), ("low", v == low), ("between", (v > low) & (v < high)), ("high", (v == high) & (v > low)))]
        counted = df.agg(*aggs).first().asDict()
        brackets = {}
        for i, (key, rank, position) in enumerate(work):
            (c, lo, hi, _), (low, high) = key, cuts[f"a{i}"]
            under, at_low, between, at_high = (counted[f"{name}{i}"] for name in ("under", "low", "between", "high"))
            above = sizes[key] - under - at_low - between - at_high
            for size, ends in ((under, (lo, low)), (at_low, low), (between, (low, high)), (at_high, high), (above, (high, hi))):
                if position < size:
                    break
                position -= size
            if isinstance(ends, tuple):
                brackets.setdefault((c, *ends, size), []).append((rank, position))
            else:
                found[c, rank] = ends
    return found
