"""Registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm import ann, exact_dedup, langid, line_dedup, mixing, packing, pii, simhash, toxicity, url_filter

#: The key of the demonstration queries; production callers pass their own secret.
PSEUDONYM_KEY = "rotate-me"

URL_RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)

#: Domains of the demonstration corpus, by the last digit of a source's name; also valid in DuckDB.
DOMAIN_SQL = (
    "CASE WHEN source IS NULL THEN '(none)' WHEN right(source, 1) IN ('0', '1', '2', '3', '4') THEN 'web' "
    "WHEN right(source, 1) IN ('5', '6', '7') THEN 'books' ELSE 'news' END"
)
MIX_WEIGHTS = {"domain": {"web": 5, "books": 3, "news": 2}, "lang": {"en": 6, "de": 2, "fr": 2}, "source": {"src0": 3}}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(n: int, rest: int, id_col: str = "doc_id"):
    """Whether crc32(id as text) mod n is rest; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % n == rest, F.lit(False))


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)
    return done.select("doc_id", "text", *(F.coalesce(F.col("found")[k], F.lit(0)).alias(f"n_{k}") for k in pii.MAKERS))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"), ann.fit(vectors))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), MIX_WEIGHTS, F.expr(DOMAIN_SQL))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(~held_out(5, 0)))
    scored = docs.select("doc_id", held_out(5, 0).alias("held_out"), model.column(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out(3, 1)))
    judged = docs.select("doc_id", held_out(3, 1).alias("held_out"), model.column(F.col("text")).alias("j"))
    # the contract asks for a language for every text with letters; narrow margins are marked beside it
    return judged.select("doc_id", "held_out", F.col("j.lang").alias("lang_pred"), "j.score", "j.margin", (F.col("j.margin") < 0.01).alias("narrow"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pseudonyms, op2_line_dedup, op3_url_filter, op4_simhash, op5_ann, op6_packing, op7_mixing, op8_toxicity, op9_language, op10_exact_dedup)
}
