"""Line deduplication over levelled sorted runs (operator 8).

A line's key is the line without surrounding white space, A-Z lower-cased; only keys of at least
``MIN_LENGTH`` code points count. Keys are known by 128-bit hashes. ``Runs`` is a log-structured table:
a run holds (hash, documents, largest document id, new), bucketed and sorted by hash. Each batch of
documents is counted by hash, merge-joined with the runs that are there (rows without a partner are new
lines) and added as a run of its own; when a level holds ``FANOUT`` runs, they are compacted into one run
of the next level. Once all batches are in, a key found in ``min_docs`` documents loses its lines
everywhere but in the document with the largest id.

Null texts and empty ones are one empty line. A null id counts as one document with the smallest id;
rows that share an id are one document. Rows that are equal share their fate. Repeated lines of one
document are dropped or kept together. Texts are never cut; a table without rows gives none. Columns
other than the id and the text pass through ``drop_lines`` untouched; names beginning with ``_ld_`` are
the operator's own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwatch.llm.common import SPACES, ascii_lower, new_folder, table

MIN_LENGTH, MIN_DOCS, BATCHES, FANOUT = 20, 3, 4, 3
NO_ID = -(2**63)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """One row for each line that counts: _ld_id, _ld_text (hash of the text), pos, hash, batch."""
    rows = with_keys(docs, doc_id, text).select("_ld_id", "_ld_text", F.posexplode(lines_of(F.col(f"`{text}`"))).alias("pos", "line"))
    key = F.btrim(ascii_lower(F.col("line")), F.lit(SPACES))
    return (rows.withColumn("key", key).where(F.length("key") >= MIN_LENGTH)
            .select("_ld_id", "_ld_text", "pos", F.unhex(F.md5("key")).alias("hash"),
                    F.pmod(F.xxhash64("_ld_id"), F.lit(batches)).cast("int").alias("batch")))


def with_keys(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.withColumns({"_ld_id": F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)),
                             "_ld_text": F.xxhash64(F.col(f"`{text}`"))})


class Runs:
    """Runs of line hashes by level; level 0 holds single batches."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]

    def write(self, rows: DataFrame) -> DataFrame:
        """A run: one file for each bucket, sorted, so that later joins on the hash need no exchange of it."""
        name = f"ld_run_{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, "hash").write.bucketBy(self.buckets, "hash").sortBy("hash")
         .option("path", new_folder(self.spark, name)).saveAsTable(name))
        return self.spark.table(name)

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> None:
        """Add the lines of one batch: (hash, _ld_id)."""
        marked = lines.groupBy("hash").agg(F.countDistinct("_ld_id").alias("docs"), F.max("_ld_id").alias("last"))
        known = F.lit(False)
        for i, run in enumerate(self.all()):  # merge joins; a line without partner in any run is new
            marked = marked.join(run.select("hash", F.lit(True).alias(f"in_{i}")), "hash", "left")
            known = known | F.col(f"in_{i}").isNotNull()
        marked = marked.select("hash", "docs", "last", (~known).alias("new"))
        self.levels[0].append(self.write(marked))
        self.compact()

    def compact(self) -> None:
        for i, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(self.write(merged(level)))
                self.levels[i] = []

    def totals(self) -> DataFrame:
        """hash, docs, last, new over all runs."""
        return merged(self.all())


def merged(runs: list[DataFrame]) -> DataFrame:
    """Runs added up by hash, by merge joins of two at a time (a union of bucketed tables is not partitioned by their key)."""
    rows = runs[0]
    for run in runs[1:]:
        other = run.withColumnsRenamed({"docs": "docs2", "last": "last2", "new": "new2"})
        rows = rows.join(other, "hash", "full").select(
            "hash", (F.coalesce("docs", F.lit(0)) + F.coalesce("docs2", F.lit(0))).alias("docs"),
            F.greatest("last", "last2").alias("last"), F.greatest("new", "new2").alias("new"))
    return rows


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS,
                   batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(_ld_id, _ld_text, _ld_drops): the line positions that each document loses, for documents that lose any."""
    spark = docs.sparkSession
    path = new_folder(spark, "ld_lines")
    line_rows(docs, doc_id, text, batches).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("_ld_id long, _ld_text long, pos int, hash binary, batch int").parquet(path)
    runs = Runs(spark, fanout)
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch).select("hash", "_ld_id"))
    often = table(runs.totals().where(F.col("docs") >= min_docs).select("hash", "last"), "ld_often")
    lost = lines.drop("batch").join(often, "hash").where(F.col("_ld_id") != F.col("last"))
    return lost.groupBy("_ld_id", "_ld_text").agg(F.collect_set("pos").alias("_ld_drops"))


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with _ld_kept (the text without its dropped lines), _ld_n_lines before and _ld_n_dropped."""
    drops = table(repeated_lines(docs, doc_id, text, **options), "ld_drops").withColumnsRenamed(
        {"_ld_id": "_ld_i", "_ld_text": "_ld_t"})
    joined = with_keys(docs, doc_id, text).join(
        drops, (F.col("_ld_id") == F.col("_ld_i")) & (F.col("_ld_text") == F.col("_ld_t")), "left")
    lines = lines_of(F.col(f"`{text}`"))
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_ld_lines") - 1), "_ld_drops"), lambda i: F.col("_ld_lines")[i])
    return (joined.withColumn("_ld_lines", lines)
            .withColumns({"_ld_kept": F.when(F.col("_ld_drops").isNull(), F.coalesce(F.col(f"`{text}`"), F.lit("")))
                          .otherwise(F.array_join(stay, "\n")),
                          "_ld_n_lines": F.size("_ld_lines").cast("long"),
                          "_ld_n_dropped": F.coalesce(F.size("_ld_drops"), F.lit(0)).cast("long")})
            .drop("_ld_id", "_ld_text", "_ld_i", "_ld_t", "_ld_drops", "_ld_lines"))
