"""Multipart uploads: validation, completion, and byte offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaystone.functions.meta import etag_normalised

MIN_PART = 5 << 20


def upsert(parts: DataFrame, *order: str) -> DataFrame:
    """Re-uploading a part number replaces it: the last by ``order`` stays. A grouped maximum, not a window."""
    rest = [c for c in parts.columns if c not in ("upload_id", "part_number")]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("p")
    return parts.groupBy("upload_id", "part_number").agg(best).select("upload_id", "part_number", "p.*")


def validate(request: DataFrame, parts: DataFrame, min_part: int = MIN_PART) -> DataFrame:
    """Each requested part with its problem: InvalidPartOrder, InvalidPart, EntityTooSmall or ok."""
    have = parts.select("upload_id", "part_number", "size", F.col("etag").alias("stored"))
    rows = request.join(have, ["upload_id", "part_number"], "left")
    w = W.partitionBy("upload_id").orderBy("pos")
    rows = rows.withColumn("before", F.lag("part_number").over(w)).withColumn("after", F.lead("part_number").over(w))
    wrong = F.col("stored").isNull() | (etag_normalised(F.col("etag")) != F.col("stored"))
    problem = (
        F.when(F.col("before") >= F.col("part_number"), "InvalidPartOrder").when(wrong, "InvalidPart")
        .when(F.col("after").isNotNull() & (F.col("size") < min_part), "EntityTooSmall").otherwise("ok")
    )
    return rows.withColumn("outcome", problem).drop("before", "after", "stored")


def complete(parts: DataFrame) -> DataFrame:
    """Size, part count and entity tag (md5 over the parts' md5 bytes, and their number) of each upload.

    Parts of one upload are bounded (10,000), so gathering them in order is too.
    """
    rows = parts.groupBy("upload_id").agg(F.sum("size").alias("size"), F.count("*").alias("parts"), F.array_sort(F.collect_list(F.struct("part_number", "etag"))).alias("p"))
    joined = F.unhex(F.array_join(F.transform("p", lambda x: x["etag"]), ""))
    return rows.select("upload_id", "size", "parts", F.concat(F.md5(joined), F.lit("-"), F.col("parts").cast("string")).alias("etag"))


def offsets(parts: DataFrame) -> DataFrame:
    """Where each part begins in the whole object."""
    before = W.partitionBy("upload_id").orderBy("part_number").rowsBetween(W.unboundedPreceding, -1)
    return parts.withColumn("begins", F.coalesce(F.sum("size").over(before), F.lit(0)))


def locate(parts: DataFrame, start: int, length: int) -> DataFrame:
    """Parts that a byte range touches, with the range inside each."""
    rows = offsets(parts).withColumn("ends", F.col("begins") + F.col("size"))
    rows = rows.where((F.col("ends") > start) & (F.col("begins") < start + length))
    first = F.greatest(F.lit(0), F.lit(start) - F.col("begins"))
    return rows.withColumn("from", first).withColumn("bytes", F.least(F.col("size"), F.lit(start + length) - F.col("begins")) - first)
