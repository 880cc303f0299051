"""A corpus pipeline over ``documents``: language, repeated lines, near copies, mixture, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents. Rows with one doc_id are versions of
one document, which stay or go together. Null and empty texts have no language and leave in the first stage;
texts that lose all their lines stay, empty. An empty table passes through as an empty table.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwatch.llm import bpe, jaccard, langid, linededup, mixing
from tarnwatch.llm.common import per_text, table
from tarnwatch.session import prepare

TOKENIZER = os.path.join(os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json")
#: Near copies share five-word shingles with a similarity of 0.8 or more.
WIDTH, PERCENT = 5, 80
#: Share of the tokens that the mixture keeps, and how far it evens out the present shares.
KEEP, FLATTEN = 0.9, 0.7
ORACLE_SQL = None  # models, hashes of token ids and raking by floats; tests hold each stage against a plain version


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter and those whose language stays ambiguous go."""
    prepare(spark)
    model = langid.train(docs)
    return docs.where(langid.accepted(spark, F.col("text"), model))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least three documents hold stay in the one with the largest id only."""
    prepare(spark)
    found = linededup.drop_lines(docs)
    return found.withColumns({"text": F.col("_ld_kept"), "n_chars": F.length("_ld_kept").cast("long")}).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays."""
    prepare(spark)
    found = jaccard.components(docs, width=WIDTH, percent=PERCENT)
    gone = table(found.where("doc_id <> component_id").select("doc_id").distinct(), "pipeline_copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn towards flatter shares of source, language and topic."""
    prepare(spark)
    mixed = mixing.sample(docs, flatten=FLATTEN, keep=KEEP)
    return mixed.where("_mx_drawn").select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids and their number, and whether they decode to the text again."""
    prepare(spark)

    def run(texts):
        codec = bpe.codec(TOKENIZER)
        ids = [codec.encode(t) for t in texts]
        return [ids, [len(i) for i in ids], [codec.decode(i) == (t or "") for i, t in zip(ids, texts, strict=True)]]

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("exact", T.BooleanType())]
    return per_text(docs, "text", fields, run, ["doc_id", "lang", "source"])


STAGES = [("language", identify_language), ("lines", drop_repeated_lines), ("near_copies", drop_near_copies),
          ("mixture", mix_sources), ("tokens", encode_texts)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from documents."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
