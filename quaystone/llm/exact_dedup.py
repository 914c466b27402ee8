"""Exact deduplication: a two-pass Bloom filter finds possibly repeated hashes; only those rows shuffle.

Pass one deals 64-bit words of the hashes, nothing else of a row, over slices of the hash space. Each slice streams
its words through a Bloom filter and reports those that find all their cells set: the repeated ones and a few
others. There are as many slices as the rows need, so a slice's filter has the same size for any table. A word
that is very frequent is sent once by each batch of rows that holds it.

Pass two puts the reported words into a second filter and tests every row against it. A row that it does not let
through is unique and passes straight on; the rest are grouped by their hash. Reported words beyond the capacity
of one filter go to further ones, each of which tests the rows of its own part of the hash space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.llm._common import SPACE, lookup, stash

CELLS = 4
#: Words in a slice of pass one, on average, and bits of its filter for each of them.
SLICE_ROWS, BITS = 1 << 21, 16


def _cells(words: np.ndarray, n_bits: int, salt: int) -> np.ndarray:
    """For each word its CELLS cell numbers, by double hashing of two mixed copies."""
    x = words.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32) | np.uint64(1)
    return ((low[:, None] + high[:, None] * np.arange(CELLS, dtype=np.uint64)) % np.uint64(n_bits)).astype(np.int64)


def _once_for_each_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        words, counts = np.unique(pdf["word"].to_numpy(np.int64), return_counts=True)
        yield pd.DataFrame({"word": words, "again": counts > 1})


def _set_again(n_bits: int):
    """Words of a slice that are set again, each as often as that happens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(n_bits, bool)
        for pdf in batches:
            words, at, counts = np.unique(pdf["word"].to_numpy(np.int64), return_inverse=True, return_counts=True)
            flagged = np.zeros(len(words), bool)
            np.logical_or.at(flagged, at, pdf["again"].to_numpy(bool))
            cells = _cells(words, n_bits, 0)
            hit = (counts > 1) | flagged | table[cells].all(axis=1)
            table[cells] = True
            yield pd.DataFrame({"word": words[hit]})

    return run


def repeated_words(words: DataFrame, n: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Pass one: all words (a bigint column ``word`` of n rows) that occur more than once, and few others; with repeats."""
    slices = max(1, -(-n // slice_rows))
    dealt = words.mapInPandas(_once_for_each_batch, "word bigint, again boolean").repartition(slices, "word")
    return dealt.mapInPandas(_set_again(BITS * min(n + 64, 2 * slice_rows)), "word bigint")


def may_repeat(rows: DataFrame, found: DataFrame, max_bits: int = 1 << 28, bits_per_word: int = 12) -> DataFrame:
    """Pass two: rows with a boolean column ``_again``, true for every row whose ``word`` is among ``found``, and for few others.

    A filter has ``max_bits`` (32 MiB) at most, which is what reaches the driver and is broadcast at a time. With
    more words the hash space falls into as many ranges as there are filters. Rows should lie sorted by word inside
    their files, so that a range is read by the files' statistics.
    """
    spark = rows.sparkSession
    found = stash(found.distinct())
    n = found.count()
    if not n:
        return rows.withColumn("_again", F.lit(False))
    parts = max(1, -(-n * bits_per_word // max_bits))
    edges = [-(1 << 63) + (1 << 64) * i // parts for i in range(parts)] + [1 << 63]
    out = None
    for low, high in zip(edges, edges[1:], strict=False):
        inside = (F.col("word") >= F.lit(low)) & (F.col("word") <= F.lit(high - 1)) if parts > 1 else F.lit(True)
        n_bits = max(64, min(max_bits, -(-n * bits_per_word // parts)))
        shared = spark.sparkContext.broadcast(_filter(found.where(inside), n_bits))
        part = rows.where(inside).withColumn("_again", _lets_through(shared, n_bits)(F.col("word")))
        out = part if out is None else out.unionByName(part)
    return out


def _filter(words: DataFrame, n_bits: int) -> np.ndarray:
    """The filter of the words, packed, made from the words of one task after the other."""
    table = np.zeros((n_bits + 7) // 8, np.uint8)

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cells = np.unique(_cells(pdf["word"].to_numpy(np.int64), n_bits, 1))
            at, starts = np.unique(cells >> 3, return_index=True)
            masks = np.bitwise_or.reduceat(np.left_shift(1, 7 - (cells & 7)), starts) if len(cells) else cells
            yield pd.DataFrame({"at": [at.astype(np.int64).tobytes()], "bits": [masks.astype(np.uint8).tobytes()]})

    for r in words.mapInPandas(bits, "at binary, bits binary").toLocalIterator(prefetchPartitions=True):
        table[np.frombuffer(r["at"], np.int64)] |= np.frombuffer(r["bits"], np.uint8)
    return table


def _lets_through(shared, n_bits: int):
    @F.pandas_udf("boolean")
    def test(words: pd.Series) -> pd.Series:
        cells = _cells(words.to_numpy(np.int64), n_bits, 1)
        return pd.Series(((shared.value[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).all(axis=1))

    return test


def digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text without ASCII white space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", ""), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 1 << 28, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; null counts as empty. Of equal texts the row
    with the most code points stays, then the one with the smallest id (a null id comes last). Of rows that tie in
    both, one stays, and which one is settled by their order in the table. Other columns of docs are ignored, so
    their names cannot clash. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(digest(F.col(text_col))).alias("sha"), F.coalesce(F.char_length(text_col), F.lit(0)).alias("chars"), F.monotonically_increasing_id().alias("row"))
    rows = stash(rows.withColumn("word", F.xxhash64("sha")).sortWithinPartitions("word"))
    tested = stash(may_repeat(rows, repeated_words(rows.select("word"), rows.count(), slice_rows), max_bits).drop("word"))
    alone, again = tested.where(~F.col("_again")), tested.where("_again")
    best = F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("row").alias("r"))
    groups = again.groupBy("sha").agg(F.min(best).alias("best"), F.count("*").alias("group_size"))
    groups = stash(groups.select("sha", F.col("best.i").alias("keep_id"), F.col("best.r").alias("keep_row"), "group_size"))
    full = lookup(again, groups, "sha", "group_size")
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    return full.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), sha).unionByName(
        alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), sha)
    )
