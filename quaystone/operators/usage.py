"""Usage: objects and bytes by bucket, folder and total; quotas; capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.functions.keys import ancestors


def by_bucket(objects: DataFrame) -> DataFrame:
    return objects.groupBy("bucket").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


def with_total(objects: DataFrame) -> DataFrame:
    """By bucket, and the grand total in the row whose bucket is ``(all)``."""
    total = objects.rollup("bucket").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"), F.grouping("bucket").alias("g"))
    return total.select(F.when(F.col("g") == 1, "(all)").otherwise(F.col("bucket")).alias("bucket"), "objects", "bytes")


def by_folder(objects: DataFrame) -> DataFrame:
    """Every object credits the root ("") and all folders above it, in one pass with partial sums."""
    rows = objects.select("bucket", "size", F.explode(ancestors(F.col("key"))).alias("folder"))
    return rows.groupBy("bucket", "folder").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


def children(usage: DataFrame, bucket: str, folder: str = "") -> DataFrame:
    """A folder and those directly inside it."""
    rest = F.substring("folder", len(folder) + 1, 1 << 30)
    inside = F.startswith("folder", F.lit(folder)) & rest.rlike("^[^/]+/$")
    return usage.where((F.col("bucket") == bucket) & ((F.col("folder") == folder) | inside))


def quota_check(requests: DataFrame, config: DataFrame, usage: DataFrame) -> DataFrame:
    """Whether adding bytes to a bucket would break its quota.

    Quotas are soft: they look at the last usage snapshot, and a bucket without one is never over.
    """
    out = requests.join(config, "bucket", "left").join(usage, "bucket", "left")
    over_bytes = (F.col("quota_bytes") > 0) & (F.col("bytes") + F.col("add_bytes") > F.col("quota_bytes"))
    over_count = (F.col("quota_objects") > 0) & (F.col("objects") + 1 > F.col("quota_objects"))
    return out.withColumn("exceeded", F.coalesce(over_bytes, F.lit(False)) | F.coalesce(over_count, F.lit(False)))


def capacity(disks: DataFrame) -> DataFrame:
    online = F.coalesce("state", F.lit("")).isin("", "ok")
    return disks.agg(F.sum("total").alias("total"), F.sum("used").alias("used"), F.count_if(online).alias("online"), F.count("*").alias("disks"))


def set_health(disks: DataFrame) -> DataFrame:
    """Each set's online disks against its write quorum."""
    per_set = disks.groupBy("set_idx").agg(F.count("*").alias("disks"), F.count_if("online").alias("online"))
    quorum = (F.col("disks") - F.floor(F.col("disks") / 2) + 1).cast("bigint")
    return per_set.withColumn("write_quorum", quorum).withColumn("healthy", F.col("online") >= quorum)


def scan_usage(objects: DataFrame, now: str) -> DataFrame:
    """Bucket usage as a scan reports it: objects past their own expiry are left out, rule expiry is not looked at."""
    alive = F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(now).cast("timestamp_ntz"))
    return by_bucket(objects.where(alive))


def peers(rows: DataFrame) -> DataFrame:
    """Peers that are up, and all of them."""
    return rows.agg(F.count_if("up").alias("peers_up"), F.count("*").alias("peers_total"))


def scan_report(outcomes: DataFrame) -> DataFrame:
    """Counters of a scan pass from its outcomes (bucket, kind: expired, noncurrent, aborted, healed, tiered, error, or seen)."""
    kinds = {"expired": "objects_expired", "noncurrent": "versions_expired", "aborted": "uploads_aborted", "healed": "objects_healed", "tiered": "objects_tiered", "error": "errors"}
    return outcomes.agg(F.count_distinct("bucket").alias("buckets_scanned"), *(F.count_if(F.col("kind") == k).alias(name) for k, name in kinds.items()))
