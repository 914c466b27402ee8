"""Audit chains: each entry's hash covers the one before it."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaystone.operators.fold import ordered_fold


def entry_hash(prev: Column, body: Column) -> Column:
    return F.sha2(F.concat(prev, body), 256)


def build(entries: DataFrame, chain: str = "chain", seq: str = "seq", body: str = "body") -> DataFrame:
    """prev_hash and hash for every entry, folded in order inside each chain.

    A chain is sequential by nature, but it is not held: its entries stream through one task in order, and only the
    last hash stays. Cut chains (by day and node, say) where one task's time is too long.
    """
    kind = dict(entries.dtypes)[chain]

    def step(_: tuple, last: str | None, rows: pd.DataFrame) -> tuple[str, pd.DataFrame]:
        last, before, after = last or "", [], []
        for text in rows[body]:
            before.append(last)
            last = hashlib.sha256((last + text).encode()).hexdigest()
            after.append(last)
        return last, pd.DataFrame({chain: rows[chain], seq: rows[seq], "prev_hash": before, "hash": after})

    return ordered_fold(entries.select(chain, F.col(seq).cast("bigint").alias(seq), body), [chain], [seq], f"{chain} {kind}, {seq} bigint, prev_hash string, hash string", step)


def verify(entries: DataFrame, chain: str = "chain", seq: str = "seq", body: str = "body") -> DataFrame:
    """Each chain with its length and the first broken seq (null if whole). The first entry's link is trusted."""
    last = F.lag("hash").over(W.partitionBy(chain).orderBy(seq))
    rows = entries.withColumn("_before", last)
    linked = F.col("_before").isNull() | (F.col("prev_hash") == F.col("_before"))
    broken = ~linked | (entry_hash(F.col("prev_hash"), F.col(body)) != F.col("hash"))
    rows = rows.withColumn("_broken", broken)
    return rows.groupBy(chain).agg(F.count("*").alias("entries"), F.min(F.when(F.col("_broken"), F.col(seq))).alias("broken_seq"))


def tail(entries: DataFrame, n: int, after: int = -1) -> DataFrame:
    """The last n entries behind a seq, oldest first: a top-k, then an order of n rows."""
    return entries.where(F.col("seq") > after).orderBy(F.desc("seq")).limit(n).orderBy("seq")


def last_entry(entries: DataFrame) -> DataFrame:
    """Where a log resumes."""
    return entries.agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))
