"""A corpus pipeline of five operators; each stage reads what the one before it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm import line_dedup, mixing, near_copies, packing, toxicity
from quaystone.llm._common import fresh_name, remove, run_folder, shared_dir, stash
from quaystone.llm.queries import DOMAIN_SQL, MIX_WEIGHTS, held_out

#: Documents that score this or more go.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Scores every document and drops those that are rejected; the others pass unchanged, all columns included.

    Rows are judged by their text alone: null and empty texts stay, repeated rows share their fate, ids may be null or equal.
    Labels of ids that docs lack are ignored; without labels the seed lexicon judges. An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(5, 0))
    model = toxicity.fit(docs, labels)
    return docs.where(model.column(F.col("text")) < TOXIC)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes near-duplicate lines but the first of each class; documents of which nothing is left go.

    n_chars follows the text. Null and blank texts stay as they are, n_chars included. Rows with equal or null ids are told
    apart; an empty table stays empty.
    """
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts that share four fifths of their five-word shingles.

    It is the one with the smallest id, a null id last; of rows that share the id, the first in the table, so repeated rows
    leave one. Null, empty and blank texts are one group. An empty table stays empty.
    """
    return near_copies.drop_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each leaf's part of nine tenths of the tokens, every row once at most.

    Null languages and sources are leaves of their own. Rows are taken one by one, also where ids are equal or null. Texts
    without tokens cost nothing and are taken if the prefix reaches them. An empty table stays empty.
    """
    row = fresh_name(docs, "row_number")
    held = stash(docs.withColumn(row, F.monotonically_increasing_id()))
    plan = mixing.mix(held, MIX_WEIGHTS, F.expr(DOMAIN_SQL), budget_share=0.9, max_epochs=1, carry=[row])
    return held.join(plan.where("copies > 0").select(row), row, "left_semi").select(*docs.columns)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document that is left, with its length bucket and batch.

    Null and empty texts have no tokens and their own place in the first bucket; repeated rows are packed one by one. An
    empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

#: Toxicity and near copies have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again.

    What a stage needs in between goes as soon as its result is written, and so does the result before it; the last one stays.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    base = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        with run_folder(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
