"""SimHash near-duplicates over a segment-popcount embedding.

A fingerprint's 64 bits form 32 segments of two. The embedding is the vector of the segments' bit counts;
its Manhattan distance is a lower bound of the Hamming distance. Counts are held in unary (0 as 00, 1 as
01, 2 as 11), so the Manhattan distance is the bit count of an exclusive or, inside generated code.

The vector's 32 counts are cut into four blocks of eight. Within Manhattan distance 2, at least two of the
four blocks are equal, so cells of the grid over each pair of blocks (six pairs) hold every link. Pairs in
a cell are tested by the lower bound, then exactly.

Cells of more than ``hot_cell`` fingerprints are not paired. Two fingerprints differ in two bits or fewer
exactly if some word is within one bit of both; so their fingerprints are joined through these words, 65 for
each, which is exact and grows only with their number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.llm._common import lookup, stash
from quaystone.llm.components import connected_components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
#: Bits in which linked fingerprints may differ; blocks and cells follow from it.
DISTANCE = 2
BLOCKS = (0xFFFF, 0xFFFF0000, 0xFFFF00000000, 0xFFFF000000000000)
CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of the whole text as an unsigned number; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        spans = [(0, len(line))]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        spans = list(zip((ends - lengths)[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True))
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, len(spans), CHUNK):
        part = spans[k : k + CHUNK]
        counts += _bit_counts(np.fromiter((digest(line[s:e], SEED) for s, e in part), "<u8", len(part)))
    return _majority(counts, len(spans))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(counts: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def of_hashes(hashes: np.ndarray) -> int:
    """The SimHash of shingles that are hashed already; 0 without any."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        counts += _bit_counts(hashes[k : k + CHUNK].astype("<i8"))
    return _majority(counts, len(hashes))


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _unary_counts(fp: Column) -> Column:
    low, odd = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    either, both = fp.bitwiseOR(odd).bitwiseAND(low), fp.bitwiseAND(odd).bitwiseAND(low)
    return either.bitwiseOR(F.shiftleft(both, 1))


def links(prints: DataFrame, hot_cell: int = 256) -> DataFrame:
    """Links a, b that connect exactly the distinct fingerprints ``fp`` within two bits, directly or by way of others."""
    pairs = [(i, j) for i in range(4) for j in range(i)]
    cells = [F.struct(F.lit(n).alias("pair"), F.col("v").bitwiseAND(F.lit(signed(BLOCKS[i] | BLOCKS[j]))).alias("cell")) for n, (i, j) in enumerate(pairs)]
    rows = prints.select("fp", _unary_counts(F.col("fp")).alias("v")).select("fp", "v", F.explode(F.array(*cells)).alias("c"))
    rows = rows.select("fp", "v", F.xxhash64("c.pair", "c.cell").alias("cell"))
    sizes = rows.groupBy("cell").count().where("count > 1")
    rows = stash(rows.join(sizes, "cell"))
    cold = rows.where(F.col("count") <= hot_cell).drop("count")
    other = cold.select("cell", F.col("fp").alias("b"), F.col("v").alias("w"))
    near = (F.bit_count(F.col("v").bitwiseXOR(F.col("w"))) <= DISTANCE) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= DISTANCE)
    near = cold.join(other, (cold["cell"] == other["cell"]) & (F.col("fp") < F.col("b")) & near)
    hot = rows.where(F.col("count") > hot_cell).select("fp").distinct()
    return near.select(F.col("fp").alias("a"), "b").unionByName(_through_words(hot))


def _through_words(prints: DataFrame) -> DataFrame:
    """Star links that connect all fingerprints with a common word within one bit of each."""
    steps = F.array(*[F.lit(0).cast("bigint"), *(F.lit(signed(1 << i)) for i in range(64))])
    near = prints.select("fp", F.explode(F.transform(steps, lambda s: F.col("fp").bitwiseXOR(s))).alias("word"))
    least = near.groupBy("word").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("word", "b")
    return near.join(least, "word").where("fp != b").select(F.col("fp").alias("a"), "b").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_cell: int = 256) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of two bits or fewer. Texts that are null, empty
    or without words have fingerprint zero and link like any other. Rows with a null id take part and carry
    the id of their group (null if no member has one). Other columns are ignored. No rows give no rows.
    """
    rows = stash(docs.select(F.col(id_col).alias("doc_id"), _fingerprints(F.col(text_col)).alias("fp")))
    prints = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    parts = connected_components(links(prints.select("fp"), hot_cell))
    held = prints.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    held = stash(held)
    least = held.groupBy("component").agg(F.min("least").alias("component_id"))
    groups = stash(held.join(least, "component").select("fp", "component_id", "copies"))
    full = lookup(rows, groups, "fp", "copies")
    return full.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
