"""Lifecycle: rules matched by prefix and age; stale uploads; own expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.functions import times
from quaystone.operators.versions import noncurrent

#: A rule table is configuration of a thousand rules for a bucket at most; beyond that it is joined by bucket as it comes.
MOST_BROADCAST = 10_000


def small(rules: DataFrame) -> DataFrame:
    """Marks a rule table for broadcasting if it is small, by count."""
    return F.broadcast(rules) if rules.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else rules


def _with_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows with ``_rules``: those of their bucket that are enabled and whose prefix fits, in order.

    A bucket has a thousand rules at most, so they travel as one array; rows are neither multiplied nor grouped, and not
    shuffled while the buckets with rules are few enough to be broadcast.
    """
    live = rules.where(F.coalesce("status", F.lit("")).isin("", "Enabled"))
    fields = ["rule_pos", *(c for c in rules.columns if c not in ("bucket", "rule_pos", "status"))]
    each = live.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_rules"))
    out = rows.join(small(each), "bucket", "left")
    return out.withColumn("_rules", F.filter("_rules", lambda r: F.startswith(F.col("key"), r["prefix"])))


def _expiring(at: Column) -> Column:
    """The first rule that makes a row due."""
    return F.get(F.filter("_rules", lambda r: times.due(F.col("mod_time"), r["expiration_days"], r["expiration_date"], at)), F.lit(0))


def _least(field: str) -> Column:
    """The smallest threshold above zero of any rule."""
    return F.array_min(F.transform(F.filter("_rules", lambda r: r[field] > 0), lambda r: r[field]))


def expire(objects: DataFrame, rules: DataFrame, now: str) -> DataFrame:
    """Objects that are due, with the first matching rule (by rule_pos) that makes them so."""
    rule = _expiring(F.lit(now).cast("timestamp_ntz"))
    hits = _with_rules(objects, rules).withColumn("_hit", rule).where(F.col("_hit").isNotNull())
    return hits.select("bucket", "key", F.col("_hit.id").alias("rule_id"), "size")


def transition(objects: DataFrame, rules: DataFrame, now: str) -> DataFrame:
    """Objects to move to a colder tier: not expiring now, not tiered yet, first matching transition rule."""
    at = F.lit(now).cast("timestamp_ntz")
    first = F.get(F.filter("_rules", lambda r: (r["transition_days"] > 0) & times.due(F.col("mod_time"), r["transition_days"], F.lit(None), at)), F.lit(0))
    rows = _with_rules(objects, rules).where(_expiring(at).isNull()).withColumn("_hit", first)
    return rows.where(F.col("_hit").isNotNull()).select("bucket", "key", F.col("_hit.id").alias("rule_id"), "_hit.transition_tier")


def expire_noncurrent(versions: DataFrame, rules: DataFrame, now: str) -> DataFrame:
    """Noncurrent versions older than the smallest threshold of any matching rule."""
    at = F.lit(now).cast("timestamp_ntz")
    rows = _with_rules(noncurrent(versions), rules).withColumn("days", _least("noncurrent_days"))
    return rows.where(times.due(F.col("mod_time"), F.col("days"), F.lit(None), at)).select("bucket", "key", "seq", "days")


def stale_uploads(uploads: DataFrame, rules: DataFrame, now: str, default_days: int = 7) -> DataFrame:
    """Uploads to abort: older than the smallest matching threshold, or the default if that is smaller."""
    at = F.lit(now).cast("timestamp_ntz")
    rows = _with_rules(uploads, rules).withColumn("days", F.least(_least("abort_mpu_days"), F.lit(default_days)))
    return rows.where(times.due(F.col("initiated"), F.col("days"), F.lit(None), at)).select("bucket", "key", "upload_id", "days")


def own_expiry(objects: DataFrame, now: str) -> DataFrame:
    """Objects whose own expiry is strictly past."""
    return objects.where(times.expired(F.col("expires_at"), F.lit(now).cast("timestamp_ntz")))


def tier_stub(objects: DataFrame, moves: DataFrame) -> DataFrame:
    """Objects after a transition: moved ones keep their size and name their tier; encrypted and shared ones stay."""
    out = objects.join(moves.select("bucket", "key", "transition_tier"), ["bucket", "key"], "left")
    can = F.col("tier").isNull() & (F.coalesce("sse", F.lit("")) == "") & F.col("data_ref").isNull() & F.col("transition_tier").isNotNull()
    key = F.concat_ws("/", "bucket", "key")
    return out.withColumn("tier_key", F.when(can, key).otherwise(F.col("tier_key"))).withColumn("tier", F.when(can, F.col("transition_tier")).otherwise(F.col("tier"))).drop("transition_tier")
