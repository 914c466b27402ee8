"""Replica votes, placement and healing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaystone.functions import hashing

KEY = ["bucket", "key"]


def vote(replicas: DataFrame, quorum: int, first_quorum: bool = False) -> DataFrame:
    """One row for each object: the winning content, its votes, and the outcome (ok, corrupt).

    The content on most disks wins; ties go to the higher revision. It needs ``quorum`` votes to count.
    ``first_quorum`` counts only the first ``quorum`` online disks by index, as a reader that stops early does.
    """
    rows = replicas.where("online")
    if first_quorum:
        n = F.row_number().over(W.partitionBy(*KEY).orderBy("disk_idx"))
        rows = rows.withColumn("_n", n).where(F.col("_n") <= quorum)
    counts = rows.groupBy(*KEY, "content").agg(F.count("*").alias("votes"), F.max("revision").alias("revision"))
    rank = F.struct("votes", "revision", "content")
    best = counts.groupBy(*KEY).agg(F.max(rank).alias("w"))
    return best.select(*KEY, F.col("w.content").alias("content"), F.col("w.votes").alias("votes"), F.col("w.revision").alias("revision"), F.when(F.col("w.votes") >= quorum, "ok").otherwise("corrupt").alias("outcome"))


def majority(replicas: DataFrame) -> DataFrame:
    """Configuration content that most disks hold; ties go to the larger content hash."""
    counts = replicas.where("online").groupBy(*KEY, "content").agg(F.count("*").alias("votes"))
    return counts.groupBy(*KEY).agg(F.max(F.struct("votes", "content")).alias("w")).select(*KEY, "w.content", "w.votes")


def stale_replicas(replicas: DataFrame, winners: DataFrame) -> DataFrame:
    """Online replicas that differ from the winner: what read-repair overwrites."""
    won = winners.where("outcome = 'ok'").select(*KEY, F.col("content").alias("winner"))
    return replicas.where("online").join(won, KEY).where(F.col("content") != F.col("winner"))


def heal_plan(replicas: DataFrame, winners: DataFrame, data_shards: int) -> DataFrame:
    """For each object: replicas to rewrite, good ones, and whether enough are left to rebuild it."""
    won = winners.select(*KEY, F.col("content").alias("winner"))
    rows = replicas.join(won, KEY)
    good = F.col("online") & (F.col("content") == F.col("winner"))
    out = rows.groupBy(*KEY).agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"))
    return out.withColumn("recoverable", F.col("good") >= data_shards).withColumn("queued", F.col("recoverable") & (F.col("bad") > 0))


def misplaced(objects: DataFrame, n_sets: int, owner_col: str = "set_idx") -> DataFrame:
    """Objects whose set is not the one their key hashes to."""
    target = hashing.placement(F.col("key"), n_sets)
    return objects.withColumn("target", target).where(F.col(owner_col) != F.col("target"))


def drain_plan(objects: DataFrame, draining: list[int], n_sets: int, owner_col: str = "set_idx") -> DataFrame:
    """Where objects of draining sets go: the hash picks among the active ones."""
    active = [i for i in range(n_sets) if i not in draining]
    return objects.where(F.col(owner_col).isin(draining)).withColumn("target", hashing.active_placement(F.col("key"), active))


def drain_guard(n_sets: int, draining: list[int], wanted: int) -> str:
    """Why a set may not be drained, or ``ok``."""
    if not 0 <= wanted < n_sets:
        return "out of range"
    if n_sets < 2:
        return "only set"
    if wanted in draining:
        return "already draining"
    return "no active set left" if n_sets - len(draining) <= 1 else "ok"
