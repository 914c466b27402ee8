"""Readers with explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT = "seq bigint, time timestamp, method string, path string, bucket string, key string, action string, status int, access_key string, ip string, req_id string, prev_hash string, hash string"
PART = "array<struct<number:int,size:bigint,actual_size:bigint,etag:string>>"
OBJECT = f"bucket string, key string, size bigint, mod_time timestamp_ntz, etag string, content_type string, content_encoding string, storage_class string, user_meta map<string,string>, user_tags string, data_ref string, tier string, tier_key string, sse string, compressed string, plain_size bigint, parts {PART}"
META = f"struct<size:bigint,modTime:string,etag:string,revision:bigint,dataRef:string,parts:{PART}>"


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Daily JSON lines of audit entries."""
    return spark.read.schema(AUDIT).json(path)


def objects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OBJECT).parquet(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """A tree of files as objects, for uploads: bytes are read only if they are asked for."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").cast("timestamp_ntz").alias("mod_time"), "content")


def replica_documents(rows: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Parses each replica's metadata document; a damaged one becomes null."""
    return rows.withColumn("meta", F.from_json(F.col(raw_col), META))


def bucket_configs(rows: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Bucket configuration in its present envelope, or the older one without it."""
    body = "lifecycle:array<struct<id:string,prefix:string,status:string,days:int>>,quotaBytes:bigint,quotaObjects:bigint,versioning:string"
    new = F.from_json(F.col(raw_col), f"struct<updatedAt:string,config:struct<{body}>>")
    old = F.from_json(F.col(raw_col), f"struct<{body}>")
    return rows.withColumn("config", F.coalesce(new["config"], old))


def newest_config(rows: DataFrame, key: str = "bucket", stamp: str = "updated_at") -> DataFrame:
    """One row for each key: the one stamped last."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(stamp)).alias("r")).select(key, "r.*")


def byte_range(content: Column, start: Column, length: Column) -> Column:
    """Part of a binary column."""
    return F.substring(content, (start + 1).cast("int"), length.cast("int"))


def expand_endpoints(spark: SparkSession, pattern: str) -> DataFrame:
    """disk{1...4} as one row for each number; several braces give all combinations, the last one fastest."""
    import re

    out = spark.createDataFrame([("",)], "endpoint string")
    for fixed, low, high in re.findall(r"([^{}]*)(?:\{(\d+)\.\.\.(\d+)\})?", pattern):
        name = F.concat("endpoint", F.lit(fixed))
        if low:
            out = out.select(name.alias("endpoint"), F.explode(F.sequence(F.lit(int(low)), F.lit(int(high)))).alias("n")).select(F.concat("endpoint", F.col("n").cast("string")).alias("endpoint"))
        elif fixed:
            out = out.select(name.alias("endpoint"))
    return out
