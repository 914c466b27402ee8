"""Views of the bundled test tables as a store's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def web_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as objects: the host is the bucket, the path without query the key."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]*/?([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select(host.alias("bucket"), path.alias("key"), F.octet_length("html").cast("bigint").alias("size"), F.md5("html").alias("etag"), F.col("page_id").alias("id"))


def doc_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as objects of their source's bucket."""
    key = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    size = F.octet_length("text").cast("bigint")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("bucket"), key.alias("key"), size.alias("size"), F.md5("text").alias("etag"), F.sha2("text", 256).alias("data_ref"), "doc_id", F.col("text").cast("binary").alias("content")
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a version log."""
    n = F.get_json_object("props", "$.k").cast("bigint")
    bucket = F.concat(F.lit("b"), (F.col("user_id") % 10).cast("string"))
    key = F.concat(F.col("user_id").cast("string"), F.lit("/"), (n % 5).cast("string"))
    size = F.floor(F.col("value") * 100 + 0.5).cast("bigint")
    return table(spark, sf_dir, "events").select(
        bucket.alias("bucket"), key.alias("key"), F.col("event_id").alias("seq"), F.md5(F.col("event_id").cast("string")).alias("version_id"), (F.col("event_type") == "error").alias("delete_marker"),
        F.col("ts").alias("mod_time"), size.alias("size"), (F.col("event_id") % 7 == 0).alias("legal_hold"),
        F.when(F.col("event_id") % 3 == 0, "COMPLIANCE").when(F.col("event_id") % 3 == 1, "GOVERNANCE").alias("lock_mode"),
        F.timestamp_add("DAY", (F.col("event_id") % 40).cast("int"), F.col("ts")).cast("timestamp_ntz").alias("retain_until"),
        F.when(F.col("event_type") == "error", "s3:ObjectRemoved:Delete").when(F.col("event_type") == "purchase", "s3:ObjectCreated:Put").otherwise("s3:ObjectCreated:Copy").alias("kind"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a request log."""
    kind = F.col("event_type")
    method = F.when(kind == "purchase", "PUT").when(kind == "signup", "POST").when(kind == "error", "DELETE").otherwise("GET")
    status = F.when(kind == "error", F.when(F.col("event_id") % 2 == 0, 404).otherwise(503)).when(F.col("event_id") % 11 == 0, 304).otherwise(200)
    size = F.floor(F.col("value") * 100 + 0.5).cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("time"), F.col("user_id").alias("access_key"), kind.alias("action"), method.alias("method"), status.alias("status"), size.alias("bytes"),
        (F.col("value") / 10).alias("seconds"), size.alias("dur_ms"), F.col("event_id").alias("req_id"), F.when(F.col("event_id") % 4 == 0, "HIT").otherwise("MISS").alias("cache"),
        F.when(status == 404, "NoSuchKey").when(status == 503, "SlowDown").alias("code"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as uploaded parts, before re-uploads replace each other."""
    size = (F.col("l_quantity") * 1048576).cast("bigint")
    etag = F.md5(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("upload_id"), F.col("l_linenumber").alias("part_number"), size.alias("size"), etag.alias("etag"), F.col("l_shipdate").alias("last_modified"), F.col("l_partkey").alias("tie")
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as uploads."""
    bucket = F.concat(F.lit("b"), (F.col("o_custkey") % 10).cast("string"))
    key = F.concat(F.lower(F.substring("o_orderpriority", 1, 1)), F.lit("/"), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select(bucket.alias("bucket"), key.alias("key"), F.col("o_orderkey").alias("upload_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("initiated"))


def replicas(spark: SparkSession, sf_dir: str, disks: int = 6) -> DataFrame:
    """Documents on six disks each, some stale, some damaged, some offline."""
    rows = doc_objects(spark, sf_dir).withColumn("disk_idx", F.explode(F.sequence(F.lit(0), F.lit(disks - 1))))
    turn = (F.col("doc_id") + F.col("disk_idx")) % 7
    stale, damaged = turn.isin(0, 1) & (F.col("doc_id") % 3 == 0), (turn == 2) & (F.col("doc_id") % 5 == 0)
    content = F.when(damaged, F.concat(F.lit("bad"), F.col("disk_idx").cast("string"))).when(stale, F.concat(F.lit("old"), F.col("etag"))).otherwise(F.col("etag"))
    revision = F.when(stale, 1).otherwise(2).cast("bigint")
    return rows.select("bucket", "key", "disk_idx", content.alias("content"), revision.alias("revision"), ((F.col("doc_id") + F.col("disk_idx") * 3) % 11 != 0).alias("online"), "size")


RULES = "bucket string, rule_pos int, id string, prefix string, status string, expiration_days int, expiration_date timestamp_ntz, noncurrent_days int, abort_mpu_days int, transition_days int, transition_tier string"


def rules(spark: SparkSession) -> DataFrame:
    """A few lifecycle rules for each of the ten buckets of the version log."""
    import datetime as dt

    rows = []
    for b in range(10):
        name = f"b{b}"
        rows += [
            (name, 0, "short", "1", "Enabled", 7 + b, None, 5, 2, None, None),
            (name, 1, "late", "1", "Enabled", 3, None, 20, None, 10, "cold"),
            (name, 2, "off", "", "Disabled", 1, None, 1, 1, 1, "cold"),
            (name, 3, "dated", "2", "", None, dt.datetime(2024, 1, 15 + b), None, None, 12, "archive"),
            (name, 4, "rest", "", "Enabled", None, None, 12, 5, 14, "cold"),
        ]
    return spark.createDataFrame(rows, RULES)
