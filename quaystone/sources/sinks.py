"""Writers: a table is replaced as a whole by Spark's commit protocol."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.operators.fold import ordered_fold

KEY = ["bucket", "key"]


def last_of_each(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The last row of each key by ``order``; without one, by all other columns that have an order, so that the result is one of the rows whatever the plan."""
    rest = [c for c in rows.columns if c not in keys]
    by = list(order) or [f.name for f in rows.schema if f.name in rest and not isinstance(f.dataType, T.MapType)]
    if not by:
        return rows.dropDuplicates(list(keys))
    best = F.max_by(F.struct(*rest), F.struct(*by)).alias("_row")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*rows.columns)


def put_objects(old: DataFrame, new: DataFrame, *order: str) -> DataFrame:
    """Objects after a batch of puts: a put replaces the object of its key, the last one by ``order`` if the batch has several.

    Columns of ``order`` that objects lack are only looked at.
    """
    last = last_of_each(new, KEY, *order)
    last = last.drop(*[c for c in order if c not in old.columns])
    return old.join(last.select(*KEY), KEY, "left_anti").select(*old.columns).unionByName(last, allowMissingColumns=True)


def commit(current: DataFrame, writes: DataFrame, *order: str) -> DataFrame:
    """Each write with its outcome: conflict if it expects another revision, else the revision it makes.

    Writes of one key take effect one after the other, by ``order`` or else by what they expect.
    """
    now = current.select(*KEY, F.col("revision").alias("current"))
    rows = writes.join(now, KEY, "left").withColumn("current", F.coalesce("current", F.lit(0)).cast("bigint"))

    def step(_: tuple, revision: int | None, part: pd.DataFrame) -> tuple[int, pd.DataFrame]:
        revision = int(part["current"].iloc[0]) if revision is None else revision
        outcomes, made = [], []
        for expected in part["expected"]:
            ok = pd.isna(expected) or int(expected) == revision
            revision += ok
            outcomes.append("ok" if ok else "conflict")
            made.append(revision if ok else None)
        return revision, part.assign(outcome=outcomes, revision=pd.array(made, dtype="Int64"))

    schema = ", ".join(f"{name} {kind}" for name, kind in [*rows.dtypes, ("outcome", "string"), ("revision", "bigint")])
    return ordered_fold(rows, KEY, list(order) or ["expected"], schema, step)


def delete_objects(log: DataFrame, requests: DataFrame, now: str) -> DataFrame:
    """Outcome of each row of a batch delete (bucket, key, version_id or null, bypass) of versioned buckets.

    Without a version the delete puts a marker, whether or not there is an object. With one it removes that version, is
    refused (AccessDenied) if a lock holds it, and is no error if there is none.
    """
    from quaystone.operators.versions import lock_blocks

    have = log.select(*KEY, "version_id", "legal_hold", "retain_until", "lock_mode", F.lit(True).alias("existed"))
    rows = requests.join(have, [*KEY, "version_id"], "left")
    blocked = F.coalesce(lock_blocks(F.col("legal_hold"), F.col("retain_until"), F.col("lock_mode"), F.col("bypass"), F.lit(now).cast("timestamp_ntz")), F.lit(False))
    existed = F.coalesce("existed", F.lit(False))
    outcome = F.when(F.col("version_id").isNull(), "marker").when(existed & blocked, "AccessDenied").otherwise("deleted")
    return rows.withColumn("outcome", outcome).withColumn("existed", existed).drop("legal_hold", "retain_until", "lock_mode")


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path) if partition_by else df.write.mode("overwrite").parquet(path)
