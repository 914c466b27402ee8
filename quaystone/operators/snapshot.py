"""Snapshots, backups and content deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """Each key with what restoring the manifest would do: restore, unchanged or remove. One full outer join."""
    then = manifest.select("bucket", "key", F.col("version_id").alias("was"))
    now = current.select("bucket", "key", F.col("version_id").alias("now"))
    both = then.join(now, ["bucket", "key"], "full_outer")
    return both.withColumn("action", F.when(F.col("was").isNull(), "remove").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("restore"))


def totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


def created_since(manifest: DataFrame, current: DataFrame) -> DataFrame:
    return current.join(manifest.select("bucket", "key"), ["bucket", "key"], "left_anti")


def backup_plan(local: DataFrame, remote: DataFrame, by_etag: bool = False) -> DataFrame:
    """Objects to copy: absent from the remote, or of another size (and, if asked, another etag)."""
    same = ["bucket", "key", "size", *(["etag"] if by_etag else [])]
    return local.join(remote.select(*same), same, "left_anti")


def backup_skip(local: DataFrame, remote: DataFrame) -> DataFrame:
    same = ["bucket", "key", "size"]
    return local.join(remote.select(*same), same, "left_semi")


def dedup_groups(objects: DataFrame) -> DataFrame:
    """Contents that more than one object holds, with the bytes that sharing saves."""
    groups = objects.groupBy("data_ref").agg(F.count("*").alias("copies"), F.max("size").alias("size"), F.min(F.concat_ws("/", "bucket", "key")).alias("first"))
    return groups.where("copies > 1").withColumn("saved", (F.col("copies") - 1) * F.col("size"))


def collectable(blobs: DataFrame, references: DataFrame, now: Column, grace_seconds: int = 3600) -> DataFrame:
    """Blobs that no version refers to and that are older than the grace time."""
    old = blobs.where(F.timestamp_diff("SECOND", "installed_at", now) >= grace_seconds)
    return old.join(references.select(F.col("data_ref").alias("hash")), "hash", "left_anti")
