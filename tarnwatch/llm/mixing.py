"""Mixing sources to target weights by iterative proportional fitting (operator 1), DataFrame functions only.

Documents fall into cells of source, language and topic. The cells' token weights are raked: scaled in
turn to each margin's target shares, sweep after sweep, until all margins hold. The raked weight over the
tokens that are there is a cell's multiplier, and a document is drawn with probability
``min(1, scale * multiplier)``, the scale chosen so that the drawn tokens are ``keep`` of all in expectation.
Draws compare that probability with a hash of the document id, so they are repeatable and need no state.

Only cells are raked. They are as many as combinations of categories, not as documents; they are counted
once with map-side sums and dealt to one partition for each ``CELLS`` of them.

Nulls are categories of their own. Targets are given for a margin as {category: weight}; categories that are
not listed get weight 0 and are never drawn. Without targets a margin's are its present shares to the power
``flatten``. Empty and null texts have no tokens: they are drawn with their cell's probability, or never if
their cell has no tokens at all. Rows with one id share a draw. An empty table gives an empty one. Columns
of the documents pass through ``sample``; names beginning with ``_mx_`` are the operator's own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.llm.common import table

SWEEPS, CUT_EVERY, CELLS = 30, 10, 100_000
FLATTEN, KEEP = 0.7, 0.5
#: Topics by what a text holds, first match first; the rest is prose.
TOPICS = {"legal": ["icense", "opyright"], "contact": ["@", "://"], "table": [" | "], "shouting": ["!!"]}
REST = "prose"
NONE = "\x00"  # stands for a null category


def topic_of(text: Column, topics: dict[str, list[str]] = TOPICS) -> Column:
    out = F.lit(REST)
    for name, marks in reversed(topics.items()):
        found = F.lit(False)
        for m in marks:
            found = found | F.contains(text, F.lit(m))
        out = F.when(found, F.lit(name)).otherwise(out)
    return out


def token_weight(text: Column) -> Column:
    """Tokens of a text, estimated as a quarter of its UTF-8 bytes, rounded up."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4).cast("long")


def rake(cells: DataFrame, margins: list[str], targets: dict[str, dict[str, float]] | None = None,
         flatten: float = FLATTEN, sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` (margins, _mx_tokens) with _mx_weight: raked weights that sum to one."""
    cells = table(cells.where("_mx_tokens > 0"), "mix_cells")
    parts = max(1, math.ceil(cells.count() / CELLS))
    work = cells.coalesce(1) if parts == 1 else cells.repartition(parts)
    whole = Window.partitionBy()
    for m in margins:
        if targets and m in targets:
            given = F.create_map(*[F.lit(x) for k, v in targets[m].items() for x in (NONE if k is None else k, float(v))])
            goal = F.coalesce(F.try_element_at(given, F.col(m)), F.lit(0.0))
            total = float(sum(targets[m].values()))
            work = work.withColumn(f"_mx_goal_{m}", goal / total)
        else:
            shares = cells.groupBy(m).agg(F.sum("_mx_tokens").alias("_mx_sum")).withColumn("_mx_sum", F.pow("_mx_sum", F.lit(flatten)))
            shares = shares.withColumn(f"_mx_goal_{m}", F.col("_mx_sum") / F.sum("_mx_sum").over(whole)).drop("_mx_sum")
            work = work.join(F.broadcast(table(shares, "mix_goals")) if parts == 1 else shares, m)
    work = work.withColumn("_mx_weight", F.col("_mx_tokens").cast("double"))
    for sweep in range(1, sweeps + 1):
        for m in margins:
            here = F.sum("_mx_weight").over(Window.partitionBy(m))
            work = work.withColumn("_mx_weight", F.when(here > 0, F.col("_mx_weight") * F.col(f"_mx_goal_{m}") / here).otherwise(F.lit(0.0)))
        if sweep % CUT_EVERY == 0 or sweep == sweeps:
            work = table(work, "mix_raked")
            work = work.coalesce(1) if parts == 1 else work
    return work.select(*margins, "_mx_tokens", "_mx_weight")


def probabilities(raked: DataFrame, margins: list[str], keep: float = KEEP) -> DataFrame:
    """Add _mx_prob to cells: the chance of each of their documents.

    The expected tokens at a scale s are the least of S_j + s * W_j over j, with the j cells of largest
    multiplier saturated (S_j their tokens, W_j the raked weight of the others). So the scale for a budget
    B is the largest (B - S_j) / W_j.
    """
    cells = raked.withColumn("_mx_gain", F.col("_mx_weight") / F.col("_mx_tokens"))
    order = Window.orderBy(F.desc("_mx_gain"), *margins)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = cells.select(F.coalesce(F.sum("_mx_tokens").over(before), F.lit(0)).alias("s"), F.sum("_mx_weight").over(rest).alias("w"),
                          (F.sum("_mx_tokens").over(Window.partitionBy()) * keep).alias("b"))
    scale = filled.where("w > 0").agg(F.max((F.col("b") - F.col("s")) / F.col("w"))).first()[0] or 0.0
    return cells.withColumn("_mx_prob", F.least(F.lit(1.0), F.col("_mx_gain") * max(0.0, scale)))


def chance(doc_id: Column) -> Column:
    """A number in [0, 1) from the id's md5."""
    text = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16**13)


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", margins: dict[str, Column] | None = None,
           targets: dict[str, dict[str, float]] | None = None, flatten: float = FLATTEN, keep: float = KEEP) -> DataFrame:
    """``docs`` with _mx_<margin>, _mx_tokens, _mx_gain (relative to the mean), _mx_prob and _mx_drawn."""
    margins = margins or {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.col(f"`{text}`"))}
    names = [f"_mx_{m}" for m in margins]
    marked = docs.withColumns({n: F.coalesce(c.cast("string"), F.lit(NONE if n != "_mx_topic" else REST))
                               for n, c in zip(names, margins.values(), strict=True)}
                              | {"_mx_tokens": token_weight(F.col(f"`{text}`"))})
    cells = marked.groupBy(*names).agg(F.sum("_mx_tokens").alias("_mx_tokens"))
    raked = rake(cells, names, {f"_mx_{m}": t for m, t in (targets or {}).items()}, flatten)
    total = raked.agg(F.sum("_mx_tokens")).first()[0] or 0
    found = table(probabilities(raked, names, keep), "mix_probabilities").select(
        *names, (F.col("_mx_gain") * total).alias("_mx_gain"), "_mx_prob")
    joined = marked.join(found, names, "left")
    prob = F.coalesce("_mx_prob", F.lit(0.0))
    return joined.withColumns({"_mx_gain": F.coalesce("_mx_gain", F.lit(0.0)), "_mx_prob": prob,
                               "_mx_drawn": chance(F.col(f"`{doc_id}`")) < prob})
