"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: A key is heavy if it holds at least one row in so many; there can be no more heavy keys than this.
HEAVY_PARTS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests in one process) a temporary folder is used.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.gettempdir() + "/quaystone-shared"
    return path.rstrip("/")


_FOLDER: contextvars.ContextVar[str | None] = contextvars.ContextVar("folder", default=None)


@contextlib.contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """A folder inside the shared one for all that is stashed meanwhile; it goes at the end, so write what is to stay elsewhere."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    token = _FOLDER.set(path)
    try:
        yield path
    finally:
        _FOLDER.reset(token)
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stash(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder, or the run's own folder in it, and reads it back.

    It cuts the lineage, survives lost executors, and gives the planner real sizes. Outside ``run_folder`` the table stays
    until the shared folder is cleared, as a result may still be read from it.
    """
    spark = df.sparkSession
    path = f"{_FOLDER.get() or shared_dir(spark)}/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df does not have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def n_words(text: Column) -> Column:
    """The number of maximal runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def lookup(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of rows with groups (one row for each key, ``size`` rows of ``rows`` each), safe under skew.

    Keys that hold a thousandth of the grouped rows or more number 1000 at most, so broadcasting them is
    bounded whatever the input; all other keys are small and are joined by a shuffle.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    heavy = groups.where(F.col(size) * HEAVY_PARTS >= F.lit(total)).where(F.col(size) > 1000)
    names = {r[0] for r in heavy.select(key).collect()}
    if not names:
        return rows.join(groups, key)
    is_heavy = F.col(key).isin(list(names))
    return rows.where(is_heavy).join(F.broadcast(groups.where(is_heavy)), key).unionByName(
        rows.where(~is_heavy).join(groups.where(~is_heavy), key)
    )
