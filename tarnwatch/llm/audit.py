"""Filter interaction audit: what every order of a set of filters keeps, removes and repeats (operator 11).

A document is reduced to a mask, one bit for each filter it fails, and masks to weighted cells (part, mask, good,
toxic) by a map-side combined count; a part has 2**filters * 4 cells at most, however many documents. Each cell is
folded across the array of all filter orders, a constant of the plan that goes to every task with it: ``transform``
over the orders and ``aggregate`` along each order yield one struct a step (600 for five filters), weighted by the
cell. Cells of a part are merged by elementwise sums of these structs.

The duplicate filter fails each document whose text a smaller id holds anywhere in the table. Texts meet as
SHA-256 digests: the smallest id of a text is a map-side combined minimum, and a document looks its own (text, id)
up among them, so copies that hold a third of all rows spread by id.

Null texts are empty, null parts are an empty string. A row without an id is a copy of nothing and nothing is a
copy of it; rows that share an id are no copies of one another and count one by one. Several labels of one id count
as good or toxic if any says so; labels of no document, and those without an id, count nothing. Very long texts are read whole. A table
without rows gives none. Only the id, text and part of the documents and the label columns are read, so other
columns may have any name.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch.llm.common import SPACES, table

#: The filters in the order of their bits; a duplicate filter (E) is added by ``masks``.
FILTERS = "ABCDE"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> Column:
    """Bits of the filters that look at one text: few words, few distinct words, many capitals, symbols."""
    words = F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = [n < 100, 100 * distinct < 80 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text), F.regexp_like(text, F.lit("[#$%&*|]"))]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).cast("int")


def masks(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang",
          quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, mask, good, toxic, n): documents by part, failed filters and labels."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    seen = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(F.encode(body, "utf-8"), 256)).alias("digest"), text_failures(body).alias("mask"))
    seen = table(seen.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n")), "au_masks")
    first = seen.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.groupBy(F.col(f"`{doc_id}`").alias("id")).agg(F.max(F.col(f"`{quality}`") == 1).alias("good"), F.max(F.col(f"`{toxic}`") == 1).alias("toxic"))
    copy = F.col("first").isNull() & F.col("id").isNotNull()
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int").alias(c)
    return (seen.join(first, ["digest", "id"], "left").join(marks, "id", "left")
            .select("part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"), yes("good"), yes("toxic"), "n")
            .groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")))


def orders(filters: str = FILTERS) -> Column:
    """The order array: each order of the filters as (name, bits)."""
    return F.array(*[F.struct(F.lit("".join(filters[b] for b in p)).alias("name"), F.array(*map(F.lit, p)).alias("bits"))
                     for p in permutations(range(len(filters)))])


#: What one step of one order does with a cell: it fails the step's filter or not, and is alive or gone.
_FOLD = """
    flatten(transform(orders, o -> aggregate(o.bits,
        named_struct('alive', n, 'steps', cast(array() AS array<{step_type}>)),
        (s, b) -> named_struct(
            'alive', IF(getbit(mask, b) = 1, 0L, s.alive),
            'steps', s.steps || array(named_struct(
                'kept', IF(getbit(mask, b) = 1, 0L, s.alive),
                'removed', IF(getbit(mask, b) = 1, s.alive, 0L),
                'redundant', IF(getbit(mask, b) = 1, n - s.alive, 0L),
                'unique_fails', IF(mask = shiftleft(1, b), n, 0L),
                'good_lost', IF(getbit(mask, b) = 1, s.alive * good, 0L),
                'toxic_lost', IF(getbit(mask, b) = 1, s.alive * toxic, 0L)))),
        s -> s.steps)))""".format(step_type="struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">")

_MERGE = """
    aggregate(slice(cells, 2, size(cells)), cells[0], (total, cell) -> zip_with(total, cell, (x, y) -> named_struct({sums})))""".format(
    sums=", ".join(f"'{m}', x.{m} + y.{m}" for m in MEASURES))

#: The filter's removals over all orders, at any step.
_SHAPLEY = """
    transform(sequence(0, {last}), f -> aggregate(zip_with(flatten(transform(orders, o -> o.bits)), steps, (b, s) -> IF(b = f, s.removed, 0L)), 0L, (x, y) -> x + y))"""


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, the measures and shapley, from cells (part, mask, good, toxic, n)."""
    folded = cells.withColumn("orders", orders(filters)).select("part", F.expr(_FOLD).alias("steps"))
    total = folded.groupBy("part").agg(F.collect_list("steps").alias("cells")).select("part", F.expr(_MERGE).alias("steps"))  # 4 * 2**filters cells at most
    total = total.withColumn("orders", orders(filters)).withColumn("shapley", F.expr(_SHAPLEY.format(last=len(filters) - 1)))
    n = len(filters)
    rows = total.select("part", "orders", "shapley", F.posexplode("steps").alias("at", "s"))
    order, step = F.element_at("orders", F.floor(F.col("at") / n).cast("int") + 1), F.pmod("at", F.lit(n))
    return rows.select("part", order["name"].alias("filter_order"), (step + 1).alias("step"), *[F.col(f"s.{m}") for m in MEASURES],
                       F.element_at("shapley", F.element_at(order["bits"], step + 1) + 1).alias("shapley"))
