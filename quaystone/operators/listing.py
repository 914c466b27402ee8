"""Listings: pages of keys and common prefixes, parts and uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.functions.keys import common_prefix, search_hit, website_key

MOST_KEYS = 1000


def clamp_keys(n: int | None) -> int:
    """Zero, less, or above a thousand all mean a thousand."""
    return MOST_KEYS if n is None or n <= 0 or n > MOST_KEYS else n


def namespace(objects: DataFrame) -> DataFrame:
    """All bucket, key pairs, once each, whatever replica or set they were seen on."""
    return objects.select("bucket", "key").distinct()


def items(objects: DataFrame, bucket: str, prefix: str = "", delimiter: str = "") -> DataFrame:
    """What a listing shows: item, is_prefix, and for objects their size, etag and modification time.

    Filters come first and reach the scan; folding to prefixes is one aggregation with partial sums.
    """
    rows = objects.where((F.col("bucket") == bucket) & F.startswith("key", F.lit(prefix)))
    folded = common_prefix(F.col("key"), prefix, delimiter)
    rows = rows.withColumn("item", F.coalesce(folded, "key")).withColumn("is_prefix", folded.isNotNull())
    own = lambda c: F.max(F.when(~F.col("is_prefix"), F.col(c))).alias(c)
    return rows.groupBy("item", "is_prefix").agg(own("size"), own("etag"), F.count("*").alias("keys"))


def page(objects: DataFrame, bucket: str, prefix: str = "", delimiter: str = "", after: str = "", max_keys: int | None = None) -> DataFrame:
    """One page of a listing, in byte order, with is_truncated and next_marker on every row.

    Paging goes by the folded item, so a prefix is never shown twice. One item more than the page is read to
    tell whether there is a next one: a top-k, not a sort.
    """
    n = clamp_keys(max_keys)
    rows = items(objects, bucket, prefix, delimiter)
    if after:
        rows = rows.where(F.col("item") > after)
    top = rows.orderBy("item").limit(n + 1)
    # the page has 1001 rows at most, so numbering it in one place is bounded
    numbered = top.selectExpr("*", "row_number() OVER (ORDER BY item) AS n", "count(*) OVER () AS total")
    marker = F.expr(f"max(CASE WHEN n = {n} AND total > {n} THEN item END) OVER ()")
    return numbered.withColumn("is_truncated", F.col("total") > n).withColumn("next_marker", marker).where(F.col("n") <= n).drop("n", "total")


def start_marker(marker: str | None = None, token: str | None = None, start_after: str | None = None) -> str:
    """Where a page begins: a continuation token (base64, or raw if it is none) before start-after before marker."""
    import base64
    import binascii

    if token:
        try:
            return base64.b64decode(token, validate=True).decode()
        except (binascii.Error, UnicodeDecodeError):
            return token
    return start_after or marker or ""


def search(objects: DataFrame, bucket: str, term: str, limit: int = 1000) -> DataFrame:
    """The first hits by key of a case-insensitive search; the limit is the page's."""
    return objects.where((F.col("bucket") == bucket) & search_hit(F.col("key"), term)).orderBy("key").limit(limit)


def list_parts(parts: DataFrame, upload_id: int | str, after: int = 0, most: int = MOST_KEYS) -> DataFrame:
    rows = parts.where((F.col("upload_id") == upload_id) & (F.col("part_number") > after))
    return rows.orderBy("part_number").limit(clamp_keys(most))


def list_uploads(uploads: DataFrame, bucket: str | None = None, prefix: str = "", most: int = MOST_KEYS) -> DataFrame:
    rows = uploads if bucket is None else uploads.where(F.col("bucket") == bucket)
    return rows.where(F.startswith("key", F.lit(prefix))).orderBy("key", "upload_id").limit(clamp_keys(most))


def buckets_by_quorum(seen: DataFrame, quorum: int) -> DataFrame:
    """Buckets that enough disks know, with the earliest creation time."""
    return seen.groupBy("bucket").agg(F.count_distinct("disk_idx").alias("disks"), F.min("created").alias("created")).where(F.col("disks") >= quorum)


def missing_buckets(disks: DataFrame, seen: DataFrame) -> DataFrame:
    """Online disks that lack a bucket that some disk has. Each bucket's disks, one number each, are compared with the online ones."""
    held = seen.groupBy("bucket").agg(F.collect_set("disk_idx").alias("_held"))
    # one row, as long as there are drives
    online = disks.where("online").agg(F.collect_set("disk_idx").alias("_online"))
    return held.crossJoin(F.broadcast(online)).select("bucket", F.explode(F.array_except("_online", "_held")).alias("disk_idx"))


def bucket_stat(seen: DataFrame, bucket: str, quorum: int) -> DataFrame:
    """One bucket as enough disks know it."""
    return buckets_by_quorum(seen.where(F.col("bucket") == bucket), quorum)


def buckets(objects: DataFrame, created: DataFrame | None = None) -> DataFrame:
    """All buckets by name, empty ones too if ``created`` (bucket, created) knows them."""
    names = objects.select("bucket").distinct()
    if created is None:
        return names
    return names.join(created.groupBy("bucket").agg(F.min("created").alias("created")), "bucket", "full_outer")


def configs(rows: DataFrame, prefix: str) -> DataFrame:
    """Names of configuration documents right below a prefix, from whichever online disk has them."""
    rest = F.substring("name", len(prefix) + 1, 1 << 30)
    return rows.where(F.col("online") & F.startswith("name", F.lit(prefix))).select(F.concat(F.lit(prefix), F.substring_index(rest, "/", 1)).alias("name")).distinct()


def snapshots(manifests: DataFrame, bucket: str) -> DataFrame:
    """A bucket's snapshots without their entries, newest first."""
    return manifests.where(F.col("bucket") == bucket).select("bucket", "id", "created", "objects", "bytes").orderBy(F.desc("created"), F.desc("id"))


def with_folder_usage(rows: DataFrame, usage: DataFrame) -> DataFrame:
    """Listing rows (bucket, item, is_prefix); folders with what lies in them, as the last scan (bucket, folder, objects, bytes) saw it."""
    known = usage.select("bucket", F.col("folder").alias("item"), F.lit(True).alias("is_prefix"), "objects", "bytes")
    return rows.join(known, ["bucket", "item", "is_prefix"], "left")


def sorted_rows(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """A listing in the order of its name (case aside), size or modified column; ties by key."""
    by = {"name": F.lower("key"), "size": F.coalesce("size", F.lit(0)), "modified": F.coalesce(F.col("mod_time").cast("string"), F.lit(""))}[column]
    return rows.orderBy(by.desc() if descending else by.asc(), "key")


def recursive(objects: DataFrame, bucket: str, prefix: str = "") -> DataFrame:
    """All objects below a prefix, without pages."""
    return objects.where((F.col("bucket") == bucket) & F.startswith("key", F.lit(prefix)))


def website_objects(requests: DataFrame, objects: DataFrame, index: str = "index.html") -> DataFrame:
    """Requests (bucket, path) with the key that a website serves: the one asked for (folders get the index), else the index of a
    folder of that name; null if there is neither. Two joins."""
    asked = website_key(F.col("path"), index)
    rows = requests.withColumn("_first", asked).withColumn("_second", F.when(~F.endswith("path", F.lit("/")) & (asked != index), F.concat(asked, F.lit("/" + index))))
    have = objects.select("bucket", "key").distinct()
    for name in ("_first", "_second"):
        hit = have.select("bucket", F.col("key").alias(name), F.lit(True).alias(f"{name}_there"))
        rows = rows.join(hit, ["bucket", name], "left")
    served = F.when(F.col("_first_there"), F.col("_first")).when(F.col("_second_there"), F.col("_second"))
    return rows.withColumn("served", served).drop("_first", "_second", "_first_there", "_second_there")
