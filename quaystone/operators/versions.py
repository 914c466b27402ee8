"""Version logs: append order (``seq``) is the truth about what is latest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.sources.sinks import last_of_each

KEY = ["bucket", "key"]


def flagged(versions: DataFrame) -> DataFrame:
    """All versions with their place from the newest (1) and is_latest."""
    n = F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("seq")))
    return versions.withColumn("place", n).withColumn("is_latest", F.col("place") == 1)


def latest(versions: DataFrame) -> DataFrame:
    """The last entry of each key, as a grouped maximum with partial aggregation: no sort, no window."""
    rest = [c for c in versions.columns if c not in KEY]
    best = F.max_by(F.struct(*rest), F.col("seq")).alias("v")
    return versions.groupBy(*KEY).agg(best).select(*KEY, *[F.col(f"v.{c}").alias(c) for c in rest])


def heads(versions: DataFrame) -> DataFrame:
    """Keys whose last entry is no delete marker."""
    return latest(versions).where("NOT delete_marker")


def as_of(versions: DataFrame, when: Column) -> DataFrame:
    return latest(versions.where(F.col("mod_time") <= when))


def marker_heads(versions: DataFrame) -> DataFrame:
    return latest(versions).where("delete_marker")


def noncurrent(versions: DataFrame) -> DataFrame:
    return flagged(versions).where("NOT is_latest")


def revisions(versions: DataFrame) -> DataFrame:
    """A counter for each key that grows with each entry."""
    return versions.withColumn("revision", F.row_number().over(W.partitionBy(*KEY).orderBy("seq")).cast("bigint"))


def resolve(versions: DataFrame, version_id: str | None = None) -> DataFrame:
    return heads(versions) if version_id is None else versions.where(F.col("version_id") == version_id)


def merged_namespace(live: DataFrame, versions: DataFrame) -> DataFrame:
    """Live objects and version heads together; a key's log counts before its live entry."""
    logged = latest(versions).select(*KEY, F.col("size").alias("log_size"), F.col("delete_marker").alias("log_marker"), F.lit(True).alias("logged"))
    both = live.select(*KEY, F.col("size").alias("live_size")).join(logged, KEY, "full_outer")
    own = F.when(F.col("logged"), F.col("log_size")).otherwise(F.col("live_size"))
    return both.select(*KEY, own.alias("size"), F.coalesce("log_marker", F.lit(False)).alias("delete_marker"), F.coalesce("logged", F.lit(False)).alias("versioned"))


def lock_blocks(hold: Column, retain_until: Column, mode: Column, bypass: Column, now: Column) -> Column:
    """Whether a version may not be deleted."""
    kept = F.coalesce(retain_until > now, F.lit(False))
    return F.coalesce(hold, F.lit(False)) | (kept & ((mode == "COMPLIANCE") | ((mode == "GOVERNANCE") & ~bypass)))


def retention_allowed(old_mode: Column, old_until: Column, new_mode: Column, new_until: Column, bypass: Column, now: Column) -> Column:
    """COMPLIANCE may only be extended; a shorter or other GOVERNANCE needs a bypass."""
    active = F.coalesce(old_until > now, F.lit(False))
    longer = F.coalesce(new_until >= old_until, F.lit(False)) & (new_mode == old_mode)
    return ~active | longer | ((old_mode == "GOVERNANCE") & bypass)


# Changes: the old table and a request give the new table.


def put(versions: DataFrame, new: DataFrame, suspended: bool = False, order: Sequence[str] = ()) -> DataFrame:
    """Appends new heads; in a suspended bucket they replace the entry whose id is ``null``.

    Several puts of one key in a batch become one version after the other, by ``order`` (columns that only say so are not
    kept), or else by all columns that have an order. In a suspended bucket the last one stays.
    """
    if suspended:
        new = last_of_each(new, KEY, *order)
        gone = versions.join(new.select(*KEY), KEY, "left_semi").where("version_id = 'null'").select(*KEY, "version_id")
        versions = versions.join(gone, [*KEY, "version_id"], "left_anti").select(*versions.columns)
        new = new.withColumn("version_id", F.lit("null"))
    return versions.unionByName(_next_seq(versions, new, order), allowMissingColumns=True)


def _next_seq(versions: DataFrame, new: DataFrame, order: Sequence[str]) -> DataFrame:
    last = versions.groupBy(*KEY).agg(F.max("seq").alias("_last"))
    by = list(order) or [f.name for f in new.schema if f.name not in KEY and not isinstance(f.dataType, T.MapType)] or KEY
    place = F.row_number().over(W.partitionBy(*KEY).orderBy(*by))
    bare = new.withColumn("_place", place).drop("seq", *[c for c in order if c not in versions.columns])
    return bare.join(last, KEY, "left").withColumn("seq", F.coalesce(F.col("_last"), F.lit(0)) + F.col("_place")).drop("_last", "_place")


def delete(versions: DataFrame, keys: DataFrame, now: str, suspended: bool = False) -> DataFrame:
    """Appends a delete marker for each key."""
    mark = keys.select(*KEY).distinct().withColumn("delete_marker", F.lit(True)).withColumn("mod_time", F.lit(now).cast("timestamp_ntz"))
    mark = mark.withColumn("version_id", F.lit("null") if suspended else F.md5(F.concat_ws("\x00", *KEY, F.lit(now))))
    return put(versions, mark, suspended)


def delete_version(versions: DataFrame, requests: DataFrame, now: str) -> DataFrame:
    """Drops versions by id unless a lock blocks it; the entry before a dropped head is the head then."""
    at = F.lit(now).cast("timestamp_ntz")
    asked = requests.select(*KEY, "version_id", "bypass")
    free = versions.join(asked, [*KEY, "version_id"]).where(~lock_blocks(F.col("legal_hold"), F.col("retain_until"), F.col("lock_mode"), F.col("bypass"), at))
    return versions.join(free.select(*KEY, "version_id"), [*KEY, "version_id"], "left_anti").select(*versions.columns)


def adopt_plain(versions: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects without a log become their log's first entry, with the id ``null``."""
    fresh = objects.join(versions.select(*KEY).distinct(), KEY, "left_anti").withColumn("version_id", F.lit("null")).withColumn("delete_marker", F.lit(False))
    return versions.unionByName(fresh.withColumn("seq", F.lit(0).cast("bigint")), allowMissingColumns=True)


def unversioned(objects: DataFrame) -> DataFrame:
    """Objects of a bucket without versioning as a listing of versions shows them: one each, ``null``, the latest."""
    return objects.withColumn("version_id", F.lit("null")).withColumn("is_latest", F.lit(True)).withColumn("delete_marker", F.lit(False))


def emptied(versions: DataFrame, bucket: str, now: str) -> DataFrame:
    """The log after a bucket has been emptied: all its entries go, other than those that a lock holds."""
    held = lock_blocks(F.col("legal_hold"), F.col("retain_until"), F.col("lock_mode"), F.lit(False), F.lit(now).cast("timestamp_ntz"))
    return versions.where((F.col("bucket") != bucket) | F.coalesce(held, F.lit(False)))
